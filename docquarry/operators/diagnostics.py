"""Reports on what ingestion produced."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions.text import fingerprint, strip


def structure_counts(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    s = sections.groupBy("document_id").agg(
        F.count_if(F.col("level") == 1).alias("sections"), F.count_if(F.col("level") >= 2).alias("subsections"))
    b = blocks.groupBy("document_id").agg(
        F.count_if(F.col("block_type") == "table").alias("tables"),
        F.count_if(F.col("block_type") == "bullet_group").alias("lists"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return s.join(b, "document_id", "full_outer").select(
        "document_id", *[zero(c) for c in ("sections", "subsections", "tables", "lists")])


def document_stats(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, mean size, duplicates inside it. Grouping by
    (document, text) first keeps one long document in many tasks."""
    per = chunks.groupBy("document_id", fingerprint(F.col("page_content")).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("page_content")).alias("size"))
    return per.groupBy("document_id").agg(
        F.sum("n").alias("chunks"), F.round(F.sum("size") / F.sum("n"), 1).alias("average_chunk_size"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate_chunks"), F.count(F.lit(1)).alias("unique_chunks"))


def corpus_report(chunks: DataFrame) -> DataFrame:
    """Totals over the corpus; blank chunks do not take part in the duplicate
    test. The median is exact: sizes are counted first, so what is sorted are
    the distinct sizes. Without chunks, ratios and means are null."""
    text = F.col("page_content")
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    n = F.length(F.coalesce(text, F.lit("")))
    by_text = chunks.groupBy(F.when(~blank, fingerprint(text)).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    texts = by_text.agg(
        F.sum("c").alias("total_chunks"),
        F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("c"))), F.lit(0)).alias("empty_chunks"),
        F.count("h").alias("unique_chunks"))
    sizes = chunks.groupBy(n.alias("size")).agg(F.count(F.lit(1)).alias("c")).agg(
        F.expr("percentile(size, 0.5, c)").alias("m"), F.sum(F.col("size") * F.col("c")).alias("s"),
        F.max("size").alias("max_chunk_length"), F.min("size").alias("min_chunk_length"))
    docs = chunks.groupBy("document_id").agg(F.lit(1).alias("x")).agg(F.count(F.lit(1)).alias("documents_processed"))
    dup = F.col("total_chunks") - F.col("unique_chunks") - F.col("empty_chunks")
    # three single-row tables
    return texts.join(F.broadcast(sizes), how="cross").join(F.broadcast(docs), how="cross").select(
        "documents_processed", "total_chunks", "unique_chunks", dup.alias("duplicate_chunks"),
        F.round(F.try_divide(dup, F.col("total_chunks")), 4).alias("duplicate_ratio"), "empty_chunks",
        (dup + F.col("empty_chunks")).alias("skipped_chunks"),
        F.round(F.try_divide("s", "total_chunks"), 1).alias("average_chunk_size"),
        F.floor("m").cast("int").alias("median_chunk_length"), "max_chunk_length", "min_chunk_length",
        F.round(F.try_divide("total_chunks", "documents_processed"), 1).alias("average_chunks_per_document"))


def type_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type")).agg(F.count(F.lit(1)).alias("chunks"))


def metadata_completeness(chunks: DataFrame, keys=V.COMPLETENESS_KEYS) -> DataFrame:
    """Share of chunks with a value, per key; one pass, then unpivoted. Null without chunks."""
    share = lambda k: F.round(F.try_divide(F.count_if(F.col(k).isNotNull() & (F.col(k).cast("string") != "")), F.count(F.lit(1))), 3).alias(k)
    return chunks.agg(*[share(k) for k in keys]).unpivot([], list(keys), "key", "completeness")


def largest_chunks(chunks: DataFrame, chunk_type: str, n: int = V.LARGEST) -> DataFrame:
    size = F.length("page_content")
    return chunks.filter(F.col("chunk_type") == chunk_type).select(
        "chunk_id", "source", "section_title", "heading_path", size.alias("length"), "bullet_count", "page_start"
    ).orderBy(F.desc("length"), "chunk_id").limit(n)


def ingest_metrics(documents: DataFrame, pages: DataFrame, chunks: DataFrame, stored: DataFrame) -> DataFrame:
    counts = [documents.agg(F.count(F.lit(1)).alias("documents")), pages.agg(F.count(F.lit(1)).alias("pages")),
              chunks.agg(F.count(F.lit(1)).alias("chunks")), stored.agg(F.count(F.lit(1)).alias("collection_size"))]
    out = counts[0]
    for c in counts[1:]:  # single-row tables
        out = out.join(F.broadcast(c), how="cross")
    return out
