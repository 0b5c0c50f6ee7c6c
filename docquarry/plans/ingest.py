"""Documents to chunk table, keyword index and reports, as stored tables of which
a run rewrites what has changed."""
from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions.scan import PAGES_PER_SEGMENT
from docquarry.functions.joins import keep_first
from docquarry.functions.text import clean_text
from docquarry.operators import diagnostics as Q
from docquarry.operators import documents as D
from docquarry.operators import index as X
from docquarry.operators.chunks import build_chunks, index_chunks
from docquarry.operators.sections import parse_pages
from docquarry.session import cut, temporary_stages
from docquarry.sources import versions as W
from docquarry.sources.tables import inspector_rows, write_report

FORMAT = 1  # of the stored rows; another number makes the next run build all documents again
SCOPE = ("carrier", "line_of_business")


@dataclass(frozen=True)
class IngestConfig:
    prefixes: tuple = V.CARRIER_PREFIXES
    max_chars: int = V.MAX_CHARS
    low_text_chars: int = V.LOW_TEXT_CHARS
    keep_blank_first_pages: bool = False
    pages_per_segment: int = PAGES_PER_SEGMENT


def settings(config: IngestConfig) -> str:
    """What the rows of a document depend on besides its pages."""
    return f"{FORMAT}|{sorted(config.prefixes)}|{config.max_chars}|{config.low_text_chars}"


def file_digests(pages: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """(relative_path, first_page, digest). The digest covers all pages of a file
    in any order: their number and two sums of hashes, so that a file of very
    many pages is summed up before anything is shuffled."""
    known = [c for name in ("text", "alt_text") for c in (F.coalesce(name, F.lit("")), F.isnull(name))]
    sums = [F.sum(F.xxhash64(F.lit(k), "page", *known).cast("decimal(20,0)")).cast("string") for k in (1, 2)]
    digest = F.md5(F.concat_ws("|", F.count(F.lit(1)), *sums, F.lit(settings(config))))
    return pages.groupBy("relative_path").agg(F.min_by("text", "page").alias("first_page"), digest.alias("digest"))


def describe(paths: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Files with their ids and the metadata of their paths."""
    docs = D.folder_metadata(paths.withColumns({
        "document_id": D.document_id(F.col("relative_path")),
        "source": F.element_at(F.split("relative_path", "/"), -1)}), prefixes=config.prefixes)
    return docs.withColumn("_c", D.classify(F.col("relative_path"))).select("*", "_c.*").drop("_c")


def surviving_documents(pages: DataFrame, config: IngestConfig = IngestConfig(), stored: DataFrame | None = None) -> DataFrame:
    """Files left after the duplicate rule, with ids and metadata, ``page_hash``
    and ``digest``. ``pages``: relative_path, page, text, alt_text; the lowest
    page decides, whatever its number. Files of ``stored`` (relative_path,
    page_hash, digest) that are not in ``pages`` take part in the rule."""
    files = cut(file_digests(pages, config), "files")
    kept = D.distinct_first_pages(files, content="first_page", keep_blank=config.keep_blank_first_pages)
    kept = kept.join(files.select("relative_path", "digest"), "relative_path")
    if stored is not None:
        others = stored.join(files.select("relative_path"), "relative_path", "left_anti")
        kept = keep_first(kept.unionByName(others.select(kept.columns)), ["page_hash"], ["relative_path"])
    return describe(kept, config)


@dataclass(frozen=True)
class Corpus:
    """The tables of one version of a stored corpus. All of them belong together,
    also while another run writes the next version."""

    spark: SparkSession
    out: str
    version: W.Version

    def _derived(self, name: str) -> str:
        if not self.version.derived:
            raise ValueError(f"{self.out} has no derived tables; call refresh")
        return f"{self.out}/derived/v={self.version.derived}/{name}"

    def _stored(self, name: str) -> DataFrame:
        """With its schema given, as a table without rows has no files to tell it."""
        path = self._derived(name)  # first, as a version without derived tables has no schema of them
        return self.spark.read.schema(W.schema_of(self.version, name)).parquet(path)

    def _table(self, name: str) -> DataFrame:
        return W.read_table(self.spark, self.out, self.version, name)

    @cached_property
    def documents(self) -> DataFrame:
        return self._table("documents")

    @cached_property
    def pages(self) -> DataFrame:
        return self._table("pages")

    @cached_property
    def chunks(self) -> DataFrame:
        """All chunks; ``local_index`` counts inside the document. A blank scope is blank, not null."""
        return self._table("chunks").fillna("", list(SCOPE))

    @property
    def catalog(self) -> DataFrame:
        """Chunks of distinct texts with ``chunk_index``, which search reads."""
        return self._stored("catalog").fillna("", list(SCOPE))

    @property
    def index(self) -> X.KeywordIndex:
        return X.KeywordIndex(*[self._stored(f"keyword_index/{name}") for name in ("postings", "weights", "corpus")])

    def report(self, name: str) -> DataFrame:
        """corpus, documents, types, completeness, inspector or metrics"""
        return self.spark.read.json(self._derived(f"reports/{name}"))


def open_corpus(spark: SparkSession, out: str) -> Corpus:
    """The newest version below ``out``."""
    return Corpus(spark, out, W.latest(spark, out))


def ingest(
    pages: DataFrame, out: str, config: IngestConfig = IngestConfig(), partial: bool = False,
    derive: bool = True, buckets: int = W.BUCKETS,
) -> int:
    """Brings the corpus below ``out`` up to date and returns its version.

    ``pages`` has all pages of all files or, with ``partial``, of some files;
    the others then stay as they are. Files whose pages and settings did not
    change are skipped; only buckets that hold a changed or removed file are
    written, and if there is none nothing is. Of files with one first page the
    first path stays; with ``partial`` a file that lost to one that is removed
    later comes back only when it is given again. A null path is no file, no
    pages give an empty corpus. ``derive=False`` leaves catalog, index and
    reports to ``refresh``. ``buckets`` counts for a new corpus only. Stages are
    deleted at the end."""
    spark = pages.sparkSession
    with temporary_stages(spark):
        version = _store(pages.filter("relative_path IS NOT NULL"), out, config, partial, W.latest(spark, out, buckets), derive)
    return version.number


def refresh(spark: SparkSession, out: str) -> int:
    """Builds catalog, index and reports of the newest version, if they are older than it."""
    version = W.latest(spark, out)
    if version.number and version.derived != version.number:
        with temporary_stages(spark):
            version = replace(version, number=version.number + 1)
            version = _derive(spark, out, version)
            W.commit(spark, out, version)
    return version.number


def _store(pages: DataFrame, out: str, config: IngestConfig, partial: bool, version: W.Version, derive: bool) -> W.Version:
    spark = pages.sparkSession
    stored = None
    if version.number:
        stored = W.read_table(spark, out, version, "documents").select("document_id", "relative_path", "page_hash", "digest")
    wanted = surviving_documents(pages, config, stored if partial else None)
    if stored is None:
        changed = cut(wanted, "changed")
        gone = changed.select("document_id")
    else:
        wanted = cut(wanted, "wanted")
        changed = cut(wanted.join(stored.select("document_id", "digest"), ["document_id", "digest"], "left_anti"), "changed")
        removed = stored.select("document_id").join(wanted.select("document_id"), "document_id", "left_anti")
        gone = cut(removed.union(changed.select("document_id")), "gone")
    touched = W.touched_buckets(gone, "document_id", version)
    if version.number and not touched:
        if derive and version.derived != version.number:
            return replace(version, number=refresh(spark, out))
        return version

    usable = D.drop_blank_pages(D.repair_low_text(pages, config.low_text_chars))
    mine = D.flatten_pages(
        usable.withColumn("document_id", D.document_id(F.col("relative_path"))).drop("relative_path"),
        changed.select("document_id"))
    cleaned = cut(mine.select("document_id", "page", clean_text(F.col("text")).alias("text"), "ocr_used"), "cleaned")
    atoms, segmented = parse_pages(cleaned, config.pages_per_segment, write_stages=True)
    chunks = build_chunks(atoms, changed, config.max_chars, segmented).drop("seg")
    after = version
    # a scope is a folder, so that a filter on it reads only that folder
    for name, rows, scope in (("documents", changed, ()), ("pages", cleaned, ()), ("chunks", chunks, SCOPE)):
        after = W.rewrite(spark, out, after, name, rows, gone, touched, "document_id", scope)
    after = replace(after, number=version.number + 1)
    if derive:
        after = _derive(spark, out, after)
    W.commit(spark, out, after)
    return after


def _derive(spark: SparkSession, out: str, version: W.Version) -> W.Version:
    """Tables that depend on all documents, in folders of their own for this version."""
    now = replace(version, derived=version.number)
    target = f"{out}/derived/v={now.number}"
    chunks = Corpus(spark, out, now).chunks
    distinct = D.distinct_chunks(index_chunks(chunks, stored=True))
    distinct.write.mode("overwrite").partitionBy(*SCOPE).parquet(f"{target}/catalog")
    now = W.with_schema(now, "catalog", distinct)
    corpus = Corpus(spark, out, now)
    catalog = corpus.catalog
    index = X.build_index(catalog)
    X.write_index(index, f"{target}/keyword_index")
    for name in ("postings", "weights"):
        now = W.with_schema(now, f"keyword_index/{name}", getattr(index, name).withColumn("bucket", X.term_bucket()))
    now = W.with_schema(now, "keyword_index/corpus", index.corpus)
    for name, report in {
        "corpus": Q.corpus_report(chunks), "documents": Q.document_stats(chunks), "types": Q.type_histogram(chunks),
        "completeness": Q.metadata_completeness(chunks), "inspector": inspector_rows(catalog),
        "metrics": Q.ingest_metrics(corpus.documents, corpus.pages, chunks, catalog),
    }.items():
        write_report(report, f"{target}/reports/{name}")
    return now
