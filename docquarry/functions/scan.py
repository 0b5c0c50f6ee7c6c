"""Running values along a document, also when one document is huge.

A document is cut into segments of pages. Running values are windows inside a
segment; what a segment needs from the ones before it (its *carry*) comes from
one summary row per segment. Documents of a single segment need no carry, so
``carry`` is only computed when a document longer than a segment exists.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGES_PER_SEGMENT = 2048


def with_segments(pages: DataFrame, per_segment: int = PAGES_PER_SEGMENT) -> DataFrame:
    return pages.withColumn("seg", F.floor((F.col("page") - 1) / per_segment).cast("int"))


def has_long_documents(pages: DataFrame, per_segment: int = PAGES_PER_SEGMENT) -> bool:
    """Reads the page column only, and stops at the first long document."""
    return not pages.filter(F.col("page") > per_segment).select("page").limit(1).isEmpty()


def local(order: list[str], key: list[str] = ("document_id",)) -> Window:
    return Window.partitionBy(*key, "seg").orderBy(*order)


def running(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def after(w: Window) -> Window:
    return w.rowsBetween(1, Window.unboundedFollowing)


def first_value(c: Column, order: list[str]) -> Column:
    """First non-null ``c`` by ``order``, as an aggregate with map-side combine."""
    return F.min_by(c, F.when(c.isNotNull(), F.struct(*order)))


def last_value(c: Column, order: list[str]) -> Column:
    return F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))


def add_carry(df: DataFrame, summary: DataFrame, key: list[str] = ("document_id",)) -> DataFrame:
    """Attach the carry of each segment; both sides are keyed by segment, so a
    long document stays spread over its segments."""
    return df.join(summary, [*key, "seg"], "left")


def neighbours(
    df: DataFrame, order: list[str], cols: list[str], segmented: bool = False,
    key: list[str] = ("document_id",),
) -> DataFrame:
    """Adds structs ``prev`` and ``next`` with ``cols`` of the rows around."""
    w, row = local(order, key), F.struct(*cols)
    out = df.withColumns({"prev": F.lag(row).over(w), "next": F.lead(row).over(w)})
    if not segmented:
        return out
    per = df.groupBy(*key, "seg").agg(first_value(row, order).alias("_f"), last_value(row, order).alias("_l"))
    ws = Window.partitionBy(*key).orderBy("seg")
    carry = per.select(*key, "seg", F.last("_l").over(before(ws)).alias("_carry_prev"), F.first("_f").over(after(ws)).alias("_carry_next"))
    return add_carry(out, carry, key).withColumns(
        {"prev": F.coalesce("prev", "_carry_prev"), "next": F.coalesce("next", "_carry_next")}).drop("_carry_prev", "_carry_next")


def running_total(
    df: DataFrame, order: list[str], value: Column, name: str, segmented: bool = False,
    key: list[str] = ("document_id",),
) -> DataFrame:
    """Adds the inclusive running sum of ``value``."""
    out = df.withColumn(name, F.sum(value).over(running(local(order, key))))
    if not segmented:
        return out
    per = df.groupBy(*key, "seg").agg(F.sum(value).alias("_s"))
    carry = per.select(*key, "seg", F.sum("_s").over(before(Window.partitionBy(*key).orderBy("seg"))).alias("_carry_sum"))
    return add_carry(out, carry, key).withColumn(name, F.col(name) + F.coalesce("_carry_sum", F.lit(0))).drop("_carry_sum")
