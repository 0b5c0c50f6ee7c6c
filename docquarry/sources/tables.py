"""Stored tables: catalog, keyed upsert, deletes, what is new, reports."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_catalog(chunks: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> None:
    chunks.write.mode(mode).format(fmt).save(path)


def read_catalog(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """With its schema given, so nothing is inferred; blank lines are skipped."""
    return spark.read.schema(schema).format(fmt).load(path)


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Existing rows without the incoming keys, plus one incoming row per key:
    the last by ``_seq`` or, without that column, that of the greatest hash, so
    that a repeated run stores the same row."""
    rest = [c for c in incoming.columns if c not in (key, "_seq")]
    order = F.col("_seq") if "_seq" in incoming.columns else F.xxhash64(*rest)
    incoming = incoming.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def delete_documents(chunks: DataFrame, deleted: DataFrame, key: str = "document_id") -> DataFrame:
    return chunks.join(deleted.select(key).distinct(), key, "left_anti")


def lookup(chunks: DataFrame, limit: int = 1, **where) -> DataFrame:
    """Rows with these metadata values."""
    for column, value in where.items():
        chunks = chunks.filter(F.col(column) == value)
    return chunks.limit(limit)


def new_chunks(parsed: DataFrame, stored: DataFrame, key: str = "chunk_id") -> DataFrame:
    """What is parsed but not stored yet."""
    return parsed.join(stored.select(key), key, "left_anti")


def is_fresh(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """Counts of both and whether they agree (two single-row tables)."""
    a, b = parsed.agg(F.count(F.lit(1)).alias("parsed")), stored.agg(F.count(F.lit(1)).alias("stored"))
    return a.join(F.broadcast(b), how="cross").withColumn("fresh", F.col("parsed") == F.col("stored"))


def pending_files(files: DataFrame, registry: DataFrame, key: str = "filename") -> DataFrame:
    """Files whose ingestion is not completed."""
    done = registry.filter(F.col("status") == "completed").select(key)
    return files.join(done, key, "left_anti")


def append_query_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def inspector_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "heading_path", "chunk_type", "page_start", "page_end", "semantic_type",
                         F.col("page_content").alias("text"))
