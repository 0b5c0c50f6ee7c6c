"""Shards of equal size by vector bin packing: bytes, tokens and rows together."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import pick
from docquarry.llm.registry import query
from docquarry.session import cut, spread

WEIGHTS = (32.0, 2.0, 1.0)  # of bytes, tokens and rows in the dot product
FINE = 256  # a group above this part of a shard is placed by the driver: at most 3 * shards * FINE groups
CELL = 16_384  # smaller groups that one task call places, on average
NUMBERED = 131_072  # rows that one task call numbers, on average


def word_count(text: Column) -> Column:
    """A cheap stand-in for tokens: blanks plus one."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def place(vectors: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of every group (n x d, in units of a shard's capacity), largest
    first: the one whose residual capacity (shards x d, changed in place) has the
    highest dot product with the group's vector; ties go to the first shard."""
    chosen = np.zeros(len(vectors), np.int32)
    weights = np.asarray(WEIGHTS)
    for i in np.argsort(-(vectors * weights).sum(1), kind="stable"):
        s = int(np.argmax(residual @ (vectors[i] * weights)))
        residual[s] -= vectors[i]
        chosen[i] = s
    return chosen


def shard_rows(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes + 1), crc (CRC-32 of the
    text), shard (0 to shards - 1), slot (0, 1, ... within the shard by id).

    Equal texts stay together (null counts as the empty text). Groups above
    1/256 of a shard are a bounded number and are placed one by one in the driver.
    The others are dealt by hash into cells of about ``CELL`` groups; each cell
    gets its part of every shard's residual capacity and places its groups by
    the same rule, so no task holds more than a cell. A group above the fair
    share fills a shard by itself. Repeated rows get a slot each; null ids are
    numbered first; an empty table gives no rows. ``tokens`` defaults to blanks + 1."""
    plain = pick(docs, id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    rows = cut(plain.select(
        "id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.unhex(F.sha2(text, 256)).alias("key"), (word_count(text) if tokens is None else tokens).cast("long").alias("tokens"),
        F.monotonically_increasing_id().alias("row")), "sizes")
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "groups")
    n_groups, *totals = groups.agg(F.count(F.lit(1)), F.sum("size"), F.sum("tokens"), F.sum("n")).first()
    share = np.maximum(np.array([float(t or 0) for t in totals]), 1.0) / shards
    parts = [(F.col(c) / F.lit(float(s))).alias(c) for c, s in zip(("size", "tokens", "n"), share)]
    vectors = groups.select("key", *parts)
    is_large = F.greatest("size", "tokens", "n") >= 1.0 / FINE

    large = vectors.filter(is_large).orderBy(F.desc("size"), "key").toPandas()
    residual = np.ones((shards, 3))
    large["shard"] = place(large[["size", "tokens", "n"]].to_numpy(float).reshape(-1, 3), residual)
    spark = docs.sparkSession
    placed = spark.createDataFrame([(bytes(k), int(s)) for k, s in zip(large["key"], large["shard"])], "key binary, shard int")

    cells = max(1, -(-(n_groups - len(large)) // CELL))
    left = residual / cells

    def fill(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["size", "key"], ascending=[False, True])
        return pd.DataFrame({"key": cell["key"], "shard": place(cell[["size", "tokens", "n"]].to_numpy(float), left.copy())})

    small = vectors.filter(~is_large).withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells))).groupBy("cell").applyInPandas(
        fill, "key binary, shard int")
    # hot groups are all among the large ones, whose list is bounded; the other keys have few rows each
    marked = rows.select("id", "size", "crc", "key", "row").join(F.broadcast(placed), "key", "left")
    sharded = cut(marked.filter("shard IS NOT NULL").unionByName(
        marked.filter("shard IS NULL").drop("shard").join(small, "key")).drop("key"), "shards")
    return number(sharded, int(totals[2] or 0))


def number(sharded: DataFrame, n_rows: int) -> DataFrame:
    """Gapless slots: ranks within (shard, range of ids) plus the rows of the ranges before."""
    ranges = max(1, -(-n_rows // NUMBERED))
    # row is stored and unique, so that one id with many rows does not fill one range
    dealt = sharded.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(ranges)))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY part) - n").alias("before"))
    ranked = dealt.withColumn("rank", F.expr("row_number() OVER (PARTITION BY shard, part ORDER BY id, row)"))
    return ranked.join(before, ["shard", "part"]).select("id", "size", "crc", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))


@query("op6_sharding")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    found = shard_rows(spread(spark.read.parquet(f"{sf}/documents.parquet")))
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
