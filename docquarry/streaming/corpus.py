"""Arriving pages to the stored corpus that search reads.

Every micro-batch is a partial run of ``ingest``: the files in it are built into
the same chunks, with ids, pages, sections, links and scope, and only buckets
that hold them are written. A batch that is run again finds its files unchanged
and writes nothing, so a failure between the write and the stream's checkpoint
does no harm. Catalog and index follow by ``refresh``, at the caller's pace, as
their statistics are those of the whole corpus.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry import fixed as V
from docquarry.plans.ingest import IngestConfig, ingest
from docquarry.sources import versions as W

PAGES = "relative_path string, page int, text string, alt_text string"
STATUS = "relative_path string, status string, error_message string"
STEPS = ("pending", "processing", "completed", "failed")
ANNOUNCED = -1  # the batch of files that are only announced


def _write_status(rows: DataFrame, out: str, batch: int, step: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).parquet(f"{out}/status/batch={batch}/step={STEPS.index(step)}")


def _files(pages: DataFrame, status: str, message: str | None = None) -> DataFrame:
    """One row per file of ``pages``."""
    named = pages.filter("relative_path IS NOT NULL").select("relative_path").distinct()
    return named.select("relative_path", F.lit(status).alias("status"), F.left(F.lit(message).cast("string"), F.lit(V.ERROR_CHARS)).alias("error_message"))


def _nameless(pages: DataFrame) -> DataFrame:
    """Pages without a path belong to no file and cannot be stored."""
    message = F.concat(F.lit("no path for the text "), F.coalesce("text", F.lit("")))
    return pages.filter("relative_path IS NULL").select(
        "relative_path", F.lit("failed").alias("status"), F.left(message, F.lit(V.ERROR_CHARS)).alias("error_message"))


def announce(files: DataFrame, out: str) -> None:
    """Files (relative_path) that will arrive: pending until a batch has them."""
    _write_status(_files(files, "pending"), out, ANNOUNCED, "pending", "append")


def start_corpus(
    arriving: DataFrame, out: str, checkpoint: str, config: IngestConfig = IngestConfig(), buckets: int = W.BUCKETS,
) -> StreamingQuery:
    """``arriving``: stream of pages (relative_path, page, text, alt_text); all
    pages of a file come in one batch, a later batch with the file replaces it.
    A batch that fails leaves its files failed, with the error's first 1000
    characters, and ends the stream; a new start runs the batch again."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_status(_files(batch, "processing"), out, batch_id, "processing")
        try:
            ingest(batch, out, config, partial=True, derive=False, buckets=buckets)
        except Exception as error:
            _write_status(_files(batch, "failed", str(error)), out, batch_id, "failed")
            raise
        _write_status(_files(batch, "completed").unionByName(_nameless(batch)), out, batch_id, "completed")
        W.delete_path(batch.sparkSession, f"{out}/status/batch={batch_id}/step={STEPS.index('failed')}")

    return arriving.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_status(spark: SparkSession, out: str) -> DataFrame:
    """(relative_path, status, error_message): the last state of every file; pages without a path have a row each."""
    rows = spark.read.schema(STATUS + ", batch int, step int").parquet(f"{out}/status")
    last = rows.filter("relative_path IS NOT NULL").groupBy("relative_path").agg(
        F.max_by(F.struct("status", "error_message"), F.struct("batch", "step")).alias("s")).select("relative_path", "s.*")
    return last.unionByName(rows.filter("relative_path IS NULL").select(last.columns))
