"""Keyword statistics and scores (BM25), vectors and nearest neighbours."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions.joins import guarded_join
from docquarry.functions.text import let, tokens
from docquarry.session import cut

SCOPE = ["carrier", "line_of_business"]
SCOPES = [SCOPE, ["carrier"], ["line_of_business"], []]


# --- statistics -------------------------------------------------------------------
def term_counts(words: Column) -> Column:
    """Array of (term, tf) of one chunk: sort its words, then run lengths. A
    chunk is in one row, so counting in it needs no shuffle."""
    def runs(s):
        heads = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.try_element_at(s, i - 1 + F.when(i == 1, 1).otherwise(0))))
        return let(F.when(F.size(s) > 0, heads).otherwise(F.array().cast("array<int>")), lambda h: F.transform(
            h, lambda p, i: F.struct(F.element_at(s, p).alias("term"), (
                F.coalesce(F.try_element_at(h, i + 2), F.size(s) + 1) - p).cast("long").alias("tf"))))
    return let(F.sort_array(words), runs)


def chunk_terms(chunks: DataFrame, text: str = "page_content") -> DataFrame:
    """One row per chunk: its length and its (term, tf) pairs."""
    named = [c for c in ("chunk_id", *SCOPE) if c in chunks.columns]
    return chunks.select(*named, tokens(F.col(text)).alias("_t")).select(
        *named, F.size("_t").alias("dl"), term_counts(F.col("_t")).alias("terms"))


def _counted(chunks: DataFrame, text: str) -> DataFrame:
    """Chunks whose terms are counted: as they come, or by ``chunk_terms``."""
    return chunks if "terms" in chunks.columns else chunk_terms(chunks, text)


def postings(chunks: DataFrame, text: str = "page_content") -> DataFrame:
    """(chunk_id, [scope], dl, term, tf): terms are counted inside the chunk's row, so nothing is shuffled."""
    counted = _counted(chunks, text)
    return counted.select(*[c for c in counted.columns if c != "terms"], F.inline("terms"))


HITS_PER_TASK = 2_000_000  # postings met by queries, about, whose scores one task holds
BUCKETS = 512  # folders of stored postings; a search reads those of its own terms


def term_bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def asked_postings(words: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings of the terms that some query has, handed out by chunk.

    All others are left out where they are read: stored postings by their folder, then all by
    the (measured) terms, which are sent to the tasks. Only what remains is shuffled. Scores per (query, chunk)
    are then complete inside a task, and so is the cut to the best per query: what is shuffled after
    that is a few rows per query and task, not one row per pair of a query and a chunk. ``asked`` also has
    the document frequency of every term, from which the number of these tasks follows."""
    terms = asked.select("term").distinct()
    tasks = score_tasks(asked)
    if "bucket" in words.columns:
        folders = sorted(r[0] for r in terms.select(term_bucket().alias("b")).distinct().collect())  # at most BUCKETS numbers
        words = words.filter(F.col("bucket").isin(folders)).drop("bucket")
    return guarded_join(words, terms, ["term"], "left_semi", spread=F.col("chunk_id")).repartition(tasks, "chunk_id")


def score_tasks(asked: DataFrame) -> int:
    """Tasks among which the chunks are dealt out. A posting meets every query that has its term, so the pairs that a
    task scores are as many as the document frequencies of ``asked`` (term, df) say, not as many as its postings."""
    hits = asked.agg(F.sum("df")).first()[0] or 0
    return max(asked.sparkSession.sparkContext.defaultParallelism, -(-int(hits) // HITS_PER_TASK))


def term_stats(chunks: DataFrame, text: str = "page_content") -> DataFrame:
    """Document frequency of every term. Each chunk counts a term once already
    in its own row, so this is one partial-aggregated count by term."""
    words = chunks.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(chunks: DataFrame, text: str = "page_content") -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl"))


def scoped_term_stats(chunks: DataFrame, text: str = "page_content") -> DataFrame:
    """Document frequencies for every scope (carrier and line of business, one
    of them, none; null means any). Counted once at the finest scope, then the
    small counts are rolled up."""
    words = _counted(chunks, text).select(*SCOPE, F.explode("terms.term").alias("term"))
    fine = words.groupBy(*SCOPE, "term").agg(F.count(F.lit(1)).alias("n"))
    return fine.groupingSets([[*s, "term"] for s in SCOPES], *SCOPE, "term").agg(F.sum("n").alias("df"))


def scoped_corpus_stats(chunks: DataFrame, text: str = "page_content") -> DataFrame:
    fine = _counted(chunks, text).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("c"), F.sum("dl").alias("s"))
    return fine.groupingSets(SCOPES, *SCOPE).agg(
        F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(n - df + F.lit(0.5)) - F.log(df + F.lit(0.5))


def scope_key(*names: str) -> Column:
    """One column for a scope; null parts (any) have a mark of their own."""
    return F.concat_ws("\x1f", *[F.coalesce(n, F.lit("\x00")) for n in names or SCOPE])


def scoped_idf(chunks: DataFrame, text: str = "page_content") -> tuple[DataFrame, DataFrame]:
    """(term weights, corpus statistics) by ``scope``. A negative weight is
    later replaced by a quarter of the mean weight of its scope. Both are
    written to the shared folder: they are read several times, and the number
    of scopes is then known, so that sending it to all tasks can be decided."""
    corpus = cut(scoped_corpus_stats(chunks, text).withColumn("scope", scope_key()).drop(*SCOPE), "corpus")
    stats = cut(scoped_term_stats(chunks, text).withColumn("scope", scope_key()).drop(*SCOPE), "terms")
    raw = guarded_join(stats, corpus, ["scope"], spread=F.col("term")).select(
        "scope", "term", "df", idf(F.col("n"), F.col("df")).alias("raw"))
    mean = raw.groupBy("scope").agg(F.avg("raw").alias("mean"))
    return raw, corpus.join(mean, "scope")


@dataclass(frozen=True)
class KeywordIndex:
    """What keyword search reads: postings, weights per (scope, term), totals
    per scope. Built once per corpus and stored; the postings of a stored index
    also have their folder, ``bucket``."""

    postings: DataFrame
    weights: DataFrame
    corpus: DataFrame


def build_index(chunks: DataFrame, text: str = "page_content") -> KeywordIndex:
    """Words are split once: the terms of each chunk are written, the statistics and postings read them."""
    counted = cut(chunk_terms(chunks, text), "chunk-terms")
    return KeywordIndex(postings(counted), *scoped_idf(counted))


def write_index(index: KeywordIndex, path: str) -> None:
    """Postings and weights lie in folders by their term, sorted inside each file, so that a search reads the
    folders of its terms and in these the row groups that can hold them. The rebalance splits the folder of a very
    frequent term into files of equal size."""
    for name in ("postings", "weights"):
        rows = getattr(index, name).withColumn("bucket", term_bucket())
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    index.corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def read_index(spark: SparkSession, path: str) -> KeywordIndex:
    return KeywordIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "weights", "corpus")])


def query_terms(queries: DataFrame, text: str = "search_query") -> DataFrame:
    """Terms of each query with their number; a repeated word counts again."""
    return queries.select("query_id", F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(
        F.count(F.lit(1)).alias("qtf"))


def bm25(weight: Column, tf: Column, dl: Column, avgdl: Column, k1: float = V.BM25_K1, b: float = V.BM25_B) -> Column:
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25_scores(chunks: DataFrame, queries: DataFrame, text: str = "page_content", query_text: str = "search_query") -> DataFrame:
    """Scores of all chunks that share a word with a query, whole corpus."""
    stats = cut(term_stats(chunks, text), "terms")
    # tables of a single row: the totals, and the mean weight
    weighted = stats.join(F.broadcast(corpus_stats(chunks, text)), how="cross").withColumn("raw", idf(F.col("n"), F.col("df")))
    totals = weighted.agg(F.avg("raw").alias("mean"), F.first("n").alias("n"), F.first("avgdl").alias("avgdl"))
    mine = query_terms(queries, query_text).join(stats, "term").join(F.broadcast(totals), how="cross").withColumn(
        "raw", idf(F.col("n"), F.col("df"))).select(
        "query_id", "term", "qtf", "df", "avgdl",
        F.when(F.col("raw") < 0, V.BM25_FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("weight"))
    mine = cut(mine, "query-terms")
    hits = guarded_join(asked_postings(postings(chunks, text), mine), mine.drop("df"), ["term"], spread=F.col("chunk_id"))
    part = F.col("qtf") * bm25(F.col("weight"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def scoped_bm25_scores(index: KeywordIndex, queries: DataFrame, query_text: str = "search_query") -> DataFrame:
    """Scores with the statistics of each query's own scope. ``queries`` has
    carrier and line_of_business (null: any)."""
    terms = query_terms(queries, query_text)
    raw, corpus = index.weights, index.corpus
    asked = terms.join(queries.select("query_id", scope_key().alias("scope"), F.col("carrier").alias("q_carrier"),
                                      F.col("line_of_business").alias("q_lob")), "query_id")
    if "bucket" in raw.columns:  # the folder is part of the key, so that only folders of asked terms are read
        asked = asked.withColumn("bucket", term_bucket())
    on = [c for c in ("bucket", "scope", "term") if c in raw.columns]
    mine = asked.join(raw, on).join(corpus, "scope").withColumn(
        "weight", F.when(F.col("raw") < 0, V.BM25_FLOOR * F.col("mean")).otherwise(F.col("raw")))
    mine = cut(mine.select("query_id", "term", "qtf", "df", "avgdl", "q_carrier", "q_lob", "weight"), "query-terms")
    inside = (F.col("q_carrier").isNull() | (F.col("q_carrier") == F.col("carrier"))) & (
        F.col("q_lob").isNull() | (F.col("q_lob") == F.col("line_of_business")))
    hits = guarded_join(asked_postings(index.postings, mine), mine.drop("df"), ["term"], condition=inside, spread=F.col("chunk_id"))
    part = F.col("qtf") * bm25(F.col("weight"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, order: list[Column], key: list[str] = ("query_id",), name: str = "rank") -> DataFrame:
    """The first ``k`` rows per key. Spark cuts each task's rows to ``k`` per
    key before the shuffle, so a key with very many rows is no bottleneck."""
    return scores.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(name) <= k)


# --- vectors ------------------------------------------------------------------------
def query_prefix(model: str) -> str:
    return V.BGE_INSTRUCTION if "bge" in model.lower() else ""


def encode_with(df: DataFrame, text: str, make_encoder: Callable[[], Callable], prefix: str = "") -> DataFrame:
    """Plug in a model: ``make_encoder()`` runs once per task and returns a
    function from a list of texts to an array of vectors."""
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            v = np.asarray(encoder([prefix + (t or "") for t in texts]), dtype=np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(v.astype(np.float32)))
    return df.withColumn("embedding", encode(F.col(text)))


def encode_hashed(chunks: DataFrame, queries: DataFrame, dim: int = 256, text: str = "page_content",
                  query_text: str = "query") -> tuple[DataFrame, DataFrame]:
    """Unit vectors of hashed, idf-weighted words; weights come from the chunks."""
    hashing = HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_tf")
    prepared = hashing.transform(chunks.withColumn("_tokens", tokens(F.col(text))))
    model = IDF(inputCol="_tf", outputCol="_idf").fit(prepared)
    unit = Normalizer(inputCol="_idf", outputCol="_unit")

    def finish(df):
        return unit.transform(model.transform(df)).withColumn(
            "embedding", vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_idf", "_unit")

    return finish(prepared), finish(hashing.transform(queries.withColumn("_tokens", tokens(F.col(query_text)))))


MAX_QUERY_VECTORS = 10_000  # in a slice
MAX_QUERY_BYTES = 64 << 20  # of a slice's vectors, as the tasks hold them
KNN_SCHEMA = "query_id bigint, chunk_id string, score double"


def first_k(s: np.ndarray, k: int) -> np.ndarray:
    """As a stable sort by falling score would give them; only rows with ties at the cut are sorted whole."""
    if s.shape[1] <= k:
        return np.argsort(-s, axis=1, kind="stable")
    some = np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1)
    own = np.take_along_axis(s, some, 1)
    keep = np.take_along_axis(some, np.argsort(-own, axis=1, kind="stable"), 1)
    tied = np.flatnonzero((s >= own.min(1, keepdims=True)).sum(1) > k)
    keep[tied] = np.argsort(-s[tied], axis=1, kind="stable")[:, :k]
    return keep


def vector_scores(queries: pd.DataFrame, k: int):
    """Per task: exact top k of its own vectors for every query. Vectors come in
    Arrow batches; only k rows per query are ever held."""
    ids = queries["query_id"].to_numpy()
    matrix = np.stack(queries["embedding"].to_numpy()).astype(np.float64)
    scopes = {c: pd.Index(queries[c].dropna().unique()) for c in SCOPE}
    codes = {c: scopes[c].get_indexer(queries[c]) for c in SCOPE}  # -1: any

    def best(s, names):
        """k best columns of each row; equal scores in order of the name."""
        rank = np.argsort(np.argsort(names, axis=1, kind="stable"), axis=1)
        keep = np.lexsort((rank, -s), axis=1)[:, :k]
        return np.take_along_axis(s, keep, 1), np.take_along_axis(names, keep, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top_s, top_c = np.full((len(ids), 0), -np.inf), np.empty((len(ids), 0), dtype=object)
        for pdf in batches:
            for start in range(0, len(pdf), 2048):
                part = pdf.iloc[start:start + 2048].sort_values("chunk_id")
                s = np.round(matrix @ np.stack(part["embedding"].to_numpy()).astype(np.float64).T, 9)
                for c in SCOPE:
                    if len(scopes[c]):
                        mine = scopes[c].get_indexer(part[c])
                        s[(codes[c][:, None] >= 0) & (codes[c][:, None] != mine[None, :])] = -np.inf
                keep = first_k(s, k)
                names = part["chunk_id"].to_numpy(dtype=object)[keep]
                top_s, top_c = best(np.hstack([top_s, np.take_along_axis(s, keep, 1)]), np.hstack([top_c, names]))
        q, j = np.nonzero(np.isfinite(top_s))
        yield pd.DataFrame({"query_id": ids[q], "chunk_id": top_c[q, j], "score": top_s[q, j]})

    return run


def query_slices(rows: int, size: int, max_queries: int = MAX_QUERY_VECTORS, max_bytes: int = MAX_QUERY_BYTES) -> int:
    """Slices in which neither bound is passed, with room for uneven hashing."""
    fit = max(rows / max_queries, size / max_bytes)
    return 1 if fit <= 1 else -(-int(fit * 1.25 * 1000) // 1000)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = V.TOP_DENSE, max_queries: int = MAX_QUERY_VECTORS) -> DataFrame:
    """Exact nearest vectors by dot product inside each query's scope. Slices of
    the query vectors, bounded by their measured number and bytes, go to the
    tasks; more or wider queries make more slices, each one pass over the vectors."""
    wanted = [*SCOPE, "query_id", "embedding"]
    q, v = queries, vectors
    for c in SCOPE:
        q = q if c in q.columns else q.withColumn(c, F.lit(None).cast("string"))
        v = v if c in v.columns else v.withColumn(c, F.lit(None).cast("string"))
    q = q.filter(F.col("embedding").isNotNull()).select(*wanted)
    v = v.select("chunk_id", "embedding", *SCOPE)
    total, size = q.agg(F.count(F.lit(1)), F.sum(F.size("embedding").cast("long") * 8)).first()
    slices = query_slices(total, size or 0, max_queries)
    parts = []
    for i in range(slices):
        mine = q if slices == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i)
        local = mine.toPandas()  # bounded by the figures above
        if len(local):
            parts.append(v.mapInPandas(vector_scores(local, k), KNN_SCHEMA))
    if not parts:
        return v.sparkSession.createDataFrame([], KNN_SCHEMA + ", rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return top_k(found, k, [F.desc("score"), F.col("chunk_id")])
