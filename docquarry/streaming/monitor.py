"""Rolling view of query quality from the query log."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators.answers import ACCURACY, latency_bucket, merge_sketches, percentiles


def quality_windows(log: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Queries, latency and tier per window. Rows later than ``lateness`` are
    dropped and the state of closed windows is freed."""
    return (
        log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
        .groupBy(F.window("ts", window).alias("w"), "confidence_tier")
        .agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
             F.max("latency_ms").alias("max_latency_ms"))
        .select(F.col("w.start").alias("window_start"), "confidence_tier", "queries", "avg_latency_ms", "max_latency_ms")
    )


def window_sketches(log: DataFrame, window: str = "1 hour", lateness: str = "10 minutes", accuracy: float = ACCURACY) -> DataFrame:
    """Sketch of the latencies per window and tier (window_start, confidence_tier, bucket, n): its state
    grows with the range of the values, not with their number. Null and NaN latencies are left out, late rows dropped."""
    value = F.col("latency_ms").cast("double")
    return (
        log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).filter(value.isNotNull() & ~F.isnan(value))
        .groupBy(F.window("ts", window).alias("w"), "confidence_tier", latency_bucket(value, accuracy).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "confidence_tier", "bucket", "n")
    )


def start_sketches(log: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Sketches of closed windows are appended to a table."""
    return window_sketches(log, **options).writeStream.outputMode("append").format("parquet").option(
        "path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_percentiles(spark: SparkSession, path: str, *keys: str, accuracy: float = ACCURACY) -> DataFrame:
    """p50, p95 and p99 per ``keys`` (window_start and confidence_tier, or one of them: sketches of windows merge)."""
    keys = keys or ("window_start", "confidence_tier")
    return percentiles(merge_sketches(spark.read.parquet(path), *keys), *keys, accuracy=accuracy)


def start_monitor(log: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Closed windows are appended to a table."""
    return quality_windows(log, **options).writeStream.outputMode("append").format("parquet").option(
        "path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
