"""Near-duplicate documents by SimHash, found with deletion-variant signatures."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import blobs, components, pick, pieces
from docquarry.llm.registry import query
from docquarry.session import cut, spread

SEED = 42
SEGMENT = 32  # bits; two segments, so of three differing bits one segment has at most one
BLOCK = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of a whole text: A-Z lowered, words between ASCII white space,
    shingles of ``words`` words with repeats (fewer words: all of them once;
    none: 0). A bit is set if it is set in over half of the XXH64 values."""
    parts = text.lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        some = parts[start:start + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(some[k:] for k in range(words)))) if len(parts) >= words else [b" ".join(parts)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fingerprint long) of every row; null texts are empty."""
    plain = pick(docs, id=id_col, text=text_col)
    schema = T.StructType([T.StructField("id", plain.schema["id"].dataType), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                values = np.array([fingerprint(t, words) for t in blobs(batch["text"])], np.uint64)
                yield pa.record_batch([batch["id"], pa.array(values.view(np.int64))], names=["id", "fingerprint"])

    return plain.mapInArrow(run, schema)


def close_pairs(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of different fingerprints that differ in at most ``distance`` (up to 3) bits.

    The 64 bits are cut into two segments of 32, so one of them differs by at
    most one bit. Every fingerprint is indexed by each segment with one bit
    deleted, and by the segment itself. A deleted bit is 0 on one side of the
    equality join and 1 on the other, so pairs that agree on a segment meet
    once, under the segment itself, and not under each of its 32 variants. The
    number of pairs is that of the fingerprints with such a segment, not that
    of their copies. Neither side is broadcast: Spark takes the 66 entries of a
    fingerprint to be of the size of one."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one deleted bit find up to three differing bits")
    bit = F.col("place") % (SEGMENT + 1)
    cleared = F.col("segment").bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, CAST(place % {SEGMENT + 1} AS INT))")))
    signs = (
        prints.select("fingerprint").distinct()
        .select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT + 1))).alias("place"))
        .withColumn("segment", F.expr(
            f"CASE WHEN place <= {SEGMENT} THEN fingerprint ELSE shiftrightunsigned(fingerprint, {SEGMENT}) END & 4294967295"))
        .select("fingerprint", "place", F.when(bit == SEGMENT, F.col("segment")).otherwise(cleared).alias("value"),
                F.when(bit < SEGMENT, F.col("segment") != cleared).alias("one"))
    )
    key = F.shiftleft(F.col("place").cast("long"), SEGMENT).bitwiseOR(F.col("value"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    left = signs.filter("one IS NULL OR NOT one").select(key.alias("key"), F.col("fingerprint").alias("a"), F.isnull("one").alias("same"))
    right = signs.filter("one IS NULL OR one").select(key.alias("key"), F.col("fingerprint").alias("b"))
    pairs = left.join(right.hint("merge"), "key").filter(near & (~F.col("same") | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3,
) -> DataFrame:
    """One row per input row: id, fingerprint (long), component_id (the smallest
    id that is linked to it, itself included).

    Copies share a fingerprint and are one node, so a hot group costs one index
    entry. Null and empty texts have fingerprint 0 and are linked like others;
    null ids never become a component's id unless all of it are null; repeated
    rows come back as often as they went in; no rows give no rows."""
    prints = cut(fingerprints(docs, id_col, text_col, words), "prints")
    nodes = prints.groupBy("fingerprint").agg(F.min("id").alias("first"))
    roots = components(close_pairs(prints, distance), "simhash")
    named = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = named.join(least, "root").select("fingerprint", "component_id")
    # a third of the rows may share one fingerprint: Spark splits such a partition of a join
    return prints.join(known, "fingerprint").select("id", "fingerprint", "component_id")


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash_components(spread(spark.read.parquet(f"{sf}/documents.parquet")))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
