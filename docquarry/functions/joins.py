"""Joins and aggregates that stay safe when one key holds a third of the rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 100_000
MAX_BYTES = 64 * 1024 * 1024
SALTS = 64
HOT = 2_000  # rows of one key that may meet in a task, where keys are counted


def is_small(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Measure (not estimate) whether a side may be broadcast. Reads at most
    ``max_rows + 1`` rows; the answer is two numbers."""
    n, size = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*")))))
        .first()
    )
    return n <= max_rows and (size or 0) <= max_bytes


def guarded_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
    condition: Column | None = None, spread: Column | None = None, salts: int = SALTS,
) -> DataFrame:
    """Equi-join where ``big`` may have hot keys. A side measured as small is
    broadcast, so ``big`` is not shuffled at all. Otherwise ``small`` is copied
    ``salts`` times and ``big`` spread over the copies by ``spread``, so a hot
    key is cut into ``salts`` tasks; the copies are never broadcast, as Spark
    takes them to be of the size of one. ``how`` is inner, left or left_semi."""
    if is_small(small):
        joined = big.join(F.broadcast(small), on, how)
    else:
        salt = F.pmod(F.xxhash64(spread if spread is not None else F.struct(*big.columns)), F.lit(salts))
        copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = big.withColumn("_salt", salt).join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
    return joined if condition is None else joined.filter(condition)


def counted_join(
    big: DataFrame, small: DataFrame, on: list[str], rows: str, spread: Column, how: str = "inner",
) -> DataFrame:
    """Equi-join where ``big`` may have hot keys and ``small``, one row per key, says in ``rows`` how many rows of
    ``big`` have it. Only keys of more than ``HOT`` rows are copied, and only these, which are fewer than the rows
    of ``big`` by that factor, are broadcast. ``how`` is inner or left; ``rows`` is left out."""
    hot = small.filter(F.col(rows) > HOT).select(*on, F.lit(True).alias("_hot"))
    own = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0)
    salted = big.join(F.broadcast(hot), on, "left").withColumn("_salt", own).drop("_hot")
    salts = F.when(F.col(rows) > HOT, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    copies = small.withColumn("_salt", F.explode(salts)).drop(rows)
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every group. A plain aggregate, so each task already sends
    at most one row per group and copies of one text never meet in one task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    ).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
