"""Columns, texts and components shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.session import cut

MAX_ROUNDS = 40


def field(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and back ticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns that an operator reads, under its own names, so that
    other columns of the input cannot clash with those it adds."""
    return df.select(*[field(df, name).alias(alias) for alias, name in columns.items()])


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is the empty text, broken UTF-8 is replaced."""
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow column; null is the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch, so that few rows are held as Python objects at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def row_hash(*columns: Column) -> Column:
    """64 bits that decide where a row goes; never used to call rows equal."""
    return F.xxhash64(*columns)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Distributed union-find on ``edges(a, b)``: one row (node, root) for every
    node of an edge, root being the smallest node that can be reached.

    Alternates the large-star and small-star steps, whose number grows with the
    logarithm of the longest chain. Each step is two aggregates and a join by
    node, written to the shared folder, so no links or components meet in the
    driver; it sees the number of rows and a checksum. An empty input gives an
    empty result, loops and repeated edges are ignored."""
    star = cut(edges.select("a", "b").filter("a != b").distinct(), name)
    before = None
    for _ in range(MAX_ROUNDS):
        star = cut(_small_star(_large_star(star)), name)
        state = tuple(star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = star.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to its smallest neighbour."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
        linked.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()


BITS = 1 << 26  # of a filter that is sent to all tasks: 8 MB in 2,048 rows, whatever it is made from


def maybe_in(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose 64-bit ``key`` may be in ``small``: all that are, and
    few others while ``small`` has some million rows. For use before a join, so
    that only such rows are shuffled; beyond that size it lets more rows pass."""
    place = F.col(key).bitwiseAND(F.lit(BITS - 1))
    sent = small.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("_part")).agg(
        F.expr("bitmap_construct_agg(p & 32767)").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST(shiftright(_p & 32767, 3) + 1 AS INT), 1)")), 16, 10).cast("int")
    marked = big.withColumn("_p", place).withColumn("_part", F.shiftright("_p", 15))
    return marked.join(F.broadcast(sent), "_part").withColumn("_byte", byte).filter(
        "shiftright(_byte, CAST(_p & 7 AS INT)) & 1 = 1").drop("_p", "_part", "_bits", "_byte")
