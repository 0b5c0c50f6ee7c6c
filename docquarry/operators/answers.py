"""What is made of search results besides the generated text."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions.text import strip
from docquarry.operators.index import top_k


def in_order(value: Column, order: Column, sep: str) -> Column:
    """Ordered concatenation, for groups of bounded size (a query's results)."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s.v), sep)


def assemble_context(results: DataFrame) -> DataFrame:
    """One context text per query: numbered blocks with their source line."""
    head = F.format_string(
        "--- Context %d | %s (p.%s, %s, %s/%s) ---\n", "rank", "filename", F.col("page_number").cast("string"),
        F.coalesce("document_type", F.lit("document")), "carrier", "line_of_business")
    return results.groupBy("query_id").agg(
        in_order(F.concat(head, "text"), F.col("rank"), "\n\n").alias("context_text"))


def history_window(messages: DataFrame, turns: int = V.HISTORY_TURNS) -> DataFrame:
    """The last turns of each conversation as text; blank ones are left out
    after the cut."""
    last = top_k(messages, turns, [F.desc("turn")], ["conv_id"])
    said = strip(F.coalesce("text", F.lit("")))
    label = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    return last.filter(said != "").groupBy("conv_id").agg(
        in_order(F.concat(label, said), F.col("turn"), "\n").alias("history"))


def extractive_fallback(results: DataFrame, n: int = V.EXCERPT_LINES) -> DataFrame:
    """The first distinct long lines over a query's results."""
    found = results.select("query_id", "rank", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn(
        "line", strip(F.col("line"))).filter((F.length("line") > V.EXCERPT_MIN) & ~F.col("line").startswith("---"))
    firsts = found.groupBy("query_id", "line").agg(F.min(F.struct("rank", "pos")).alias("_at"))
    return top_k(firsts, n, [F.col("_at")], name="line_no").select("query_id", "line_no", "line")


def reference_list(results: DataFrame) -> DataFrame:
    """Distinct (file, page) of a query's results in order of first appearance."""
    seen = results.groupBy("query_id", "filename", "page_number").agg(
        F.min("rank").alias("first_rank"),
        F.min_by(F.concat_ws(" | ", "carrier", "line_of_business"), "rank").alias("scope"))
    w = Window.partitionBy("query_id").orderBy("first_rank")
    return seen.withColumn("reference_no", F.row_number().over(w))


def answer_tier(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Tier per query: LOW and a fixed answer without results; HIGH becomes
    MEDIUM when generation was degraded (``generation_degraded`` in queries)."""
    tiers = results.groupBy("query_id").agg(F.min_by("confidence_tier", "rank").alias("_tier"), F.max("score").alias("top_score"))
    tier = (
        F.when(F.col("_tier").isNull(), "LOW")
        .when(F.col("generation_degraded") & (F.col("_tier") == "HIGH"), "MEDIUM").otherwise(F.col("_tier"))
    )
    return queries.join(tiers, "query_id", "left").withColumns({
        "confidence_tier": tier, "fallback_answer": F.when(F.col("_tier").isNull(), V.NO_ANSWER),
    }).drop("_tier")


def source_rows(results: DataFrame) -> DataFrame:
    return results.select(
        "query_id", F.col("rank").alias("relevance_rank"), F.col("chunk_id").alias("document_id"),
        F.coalesce("filename", F.lit("Unknown Policy")).alias("filename"),
        F.coalesce(F.col("page_number").cast("string"), F.lit("Unknown")).alias("page_number"),
        F.col("text").alias("chunk_text"), F.round("score", 6).alias("relevance_score"))


def query_log_rows(answers: DataFrame) -> DataFrame:
    """The record written per answered query."""
    return answers.select("ts", "query", "rewritten_query", "confidence_tier", "top_score", "generation_degraded", "latency_ms", "error_msg")


def query_log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("confidence_tier").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"), F.round(F.avg("top_score"), 6).alias("avg_top_score"),
        F.count_if("generation_degraded").alias("degraded"))


ACCURACY = 0.01  # of percentiles, relative


def _step(accuracy: float) -> float:
    return math.log((1 + accuracy) / (1 - accuracy))


def latency_bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(_step(accuracy))).cast("int"))


def latency_sketch(log: DataFrame, *keys: str, value: str = "latency_ms", accuracy: float = ACCURACY) -> DataFrame:
    """(keys, bucket, n): how many values lie in each bucket; all of a bucket are within ``accuracy`` of its middle.

    Buckets grow by a constant factor, so a key has some thousand at most, whatever its rows, and a task sends one
    row for each. Values of 0 or less are the bucket null; null values are left out."""
    v = F.col(value).cast("double")
    return log.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, latency_bucket(v, accuracy).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of parts (days, say) as one per ``keys``: counts are added, nothing is lost."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketch: DataFrame, *keys: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), accuracy: float = ACCURACY) -> DataFrame:
    """(keys, p50, p95, ...): the values of rank ceil(share * n), within ``accuracy``; of the bucket null it is 0."""
    by = Window.partitionBy(*keys)
    below = F.sum("n").over(by.orderBy(F.asc_nulls_first("bucket")))  # a row per bucket, not per value
    middle = F.coalesce(2 * F.exp(F.col("bucket") * _step(accuracy)) / (1 + math.exp(_step(accuracy))), F.lit(0.0))
    at = sketch.withColumn("_below", below).withColumn("_all", F.sum("n").over(by)).withColumn("_value", middle)
    reached = lambda p: F.min(F.when(F.col("_below") >= F.ceil(F.lit(p) * F.col("_all")), F.col("_value")))
    return at.groupBy(*keys).agg(*[reached(p).alias(f"p{round(100 * p)}") for p in shares])
