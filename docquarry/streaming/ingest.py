"""New documents to chunks as they arrive.

Each micro-batch writes its own folder of the chunk and status tables, so a
batch that is run again after a failure replaces what it wrote before.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry import fixed as V
from docquarry.functions.joins import guarded_join, keep_first
from docquarry.functions.text import clean_text, fingerprint, strip
from docquarry.operators.chunks import fill_empty_document, token_windows
from docquarry.session import cut

CHUNKS = "document_id string, local_index int, text_hash string, text string"
STATUS = "document_id string, status string, error_message string"


def chunk_batch(documents: DataFrame, size: int = V.SPLIT_TOKENS, overlap: int = V.SPLIT_OVERLAP) -> DataFrame:
    """(document_id, text) to chunks; the position is local to the document. A
    document without text has one chunk that says so."""
    note = fill_empty_document(F.col("text"), F.col("document_id"))
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    cleaned = documents.select("document_id", F.when(blank, note).otherwise(clean_text(F.col("text"))).alias("text")).filter(F.col("text") != "")
    pieces = cleaned.select("document_id", F.posexplode(token_windows(F.col("text"), size, overlap)).alias("local_index", "text"))
    return pieces.withColumn("text_hash", fingerprint(F.col("text"))).select("document_id", "local_index", "text_hash", "text")


def batch_status(documents: DataFrame) -> DataFrame:
    """completed, or failed with a message of at most 1000 characters: a document
    without an id cannot be stored. One without text is (see ``chunk_batch``)."""
    bad = F.col("document_id").isNull()
    message = F.left(F.concat(F.lit("no document id for the text "), F.coalesce("text", F.lit(""))), F.lit(V.ERROR_CHARS))
    return documents.select("document_id", F.when(bad, "failed").otherwise("completed").alias("status"),
                            F.when(bad, message).alias("error_message"))


def start_ingest(
    arriving: DataFrame, table: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame] = chunk_batch,
) -> StreamingQuery:
    """``arriving``: stream of (document_id, text). Chunks whose text is stored
    already are not added again."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = [c.split()[0] for c in CHUNKS.split(", ")]
        firsts = cut(keep_first(chunk(batch), ["text_hash"], ["document_id", "local_index"]).select(columns), "batch")
        stored = read_chunks(spark, table).filter(F.col("batch") != batch_id).select("text_hash")
        # a batch is small against what is stored: its hashes go to the stored ones
        known = guarded_join(stored, firsts.select("text_hash"), ["text_hash"], "left_semi")
        firsts.join(known, "text_hash", "left_anti").select(columns).write.mode("overwrite").parquet(
            f"{table}/chunks/batch={batch_id}")
        batch_status(batch).write.mode("overwrite").parquet(f"{table}/status/batch={batch_id}")

    return arriving.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], schema + ", batch int")
    return spark.read.schema(schema + ", batch int").option("basePath", path).parquet(path)


def read_chunks(spark: SparkSession, table: str) -> DataFrame:
    return _read(spark, f"{table}/chunks", CHUNKS)


def read_status(spark: SparkSession, table: str) -> DataFrame:
    return _read(spark, f"{table}/status", STATUS)
