"""Greedy packing of a sequence of items into bounded packs.

A pack is closed when it holds something and ``L + length(item) > cap``, with
``L`` the sum of (length + 1) over the items in it. This is one fold per
sequence. To keep a long sequence out of one task it is cut into segments:
each segment is reduced to its effect on ``L`` (a short list of break points),
the effects are chained per sequence, and then every segment is packed on its
own from its entry value.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EFFECT = "struct<total:bigint,breaks:array<struct<above:bigint,load:bigint,opened:bigint>>>"


def _effect(lengths, cap: int):
    """Breaks are in item order: with entry load L, the first break having
    ``L > above`` is where the first new pack opens."""
    n = len(lengths)
    load, opened = [0] * (n + 1), [0] * (n + 1)
    end, size = n, 0  # items i..end-1 fit one pack of load ``size``
    for i in range(n - 1, -1, -1):
        size += int(lengths[i]) + 1
        while end > i + 1 and size - 1 > cap:
            end -= 1
            size -= int(lengths[end]) + 1
        load[i], opened[i] = (size, 1) if end == n else (load[end], 1 + opened[end])
    breaks, seen, lowest = [], 0, None
    for i in range(n):
        above = cap - seen - int(lengths[i])
        if lowest is None or above < lowest:
            breaks.append({"above": above, "load": load[i], "opened": opened[i]})
            lowest = above
        if above < 0:
            break
        seen += int(lengths[i]) + 1
    return {"total": sum(int(x) + 1 for x in lengths), "breaks": breaks}


def _numbers(lengths, load: int, pack: int, cap: int):
    out = []
    for x in lengths:
        x = int(x)
        if load == 0 or load + x > cap:
            pack, load = pack + 1, 0
        load += x + 1
        out.append(pack)
    return out


def _effect_udf(cap: int):
    @F.pandas_udf(EFFECT)
    def effect(lengths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_effect(x, cap) for x in lengths], columns=["total", "breaks"])
    return effect


def _numbers_udf(cap: int):
    @F.pandas_udf("array<bigint>")
    def numbers(lengths: pd.Series, load: pd.Series, pack: pd.Series) -> pd.Series:
        return pd.Series([_numbers(x, l, p, cap) for x, l, p in zip(lengths, load, pack)])
    return numbers


def _chain(effects: Column) -> Column:
    """Entry (load, pack) of every segment of one sequence, in order."""
    def step(acc, s):
        hit = F.try_element_at(F.filter(s.effect.breaks, lambda b: acc.load > b.above), F.lit(1))
        # a first segment opens its own first pack
        load = F.when(acc.load == 0, F.try_element_at(s.effect.breaks, F.lit(1)).load).when(
            hit.isNotNull(), hit.load).otherwise(acc.load + s.effect.total)
        opened = F.when(acc.load == 0, F.try_element_at(s.effect.breaks, F.lit(1)).opened).when(
            hit.isNotNull(), hit.opened).otherwise(F.lit(0).cast("bigint"))
        entry = F.struct(s.seg.alias("seg"), acc.load.alias("load"), acc.pack.alias("pack"))
        return F.struct(
            F.concat(acc.entries, F.array(entry)).alias("entries"),
            load.alias("load"), (acc.pack + opened).alias("pack"),
        )

    start = F.struct(
        F.array().cast("array<struct<seg:int,load:bigint,pack:bigint>>").alias("entries"),
        F.lit(0).cast("bigint").alias("load"), F.lit(-1).cast("bigint").alias("pack"),
    )
    return F.aggregate(effects, start, step, lambda acc: acc.entries)


def greedy_packs(
    items: DataFrame, key: list[str], order: list[str], length: Column, cap: int,
    segmented: bool = False,
) -> DataFrame:
    """Adds ``pack`` (0-based) to items carrying a ``seg`` column."""
    rest = [c for c in items.columns if c not in (*key, "seg")]
    segments = (
        items.withColumn("_len", length.cast("int"))
        .groupBy(*key, "seg")
        .agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in rest if c not in order], "_len"))).alias("_items"))
        .withColumn("_lens", F.col("_items._len"))
    )
    if segmented:
        entries = (
            segments.select(*key, "seg", _effect_udf(cap)("_lens").alias("effect"))
            .groupBy(*key)
            .agg(F.sort_array(F.collect_list(F.struct("seg", "effect"))).alias("_effects"))
            .select(*key, F.inline(_chain(F.col("_effects"))))
        )
        segments = segments.join(entries, [*key, "seg"])
    else:
        segments = segments.withColumns({"load": F.lit(0).cast("bigint"), "pack": F.lit(-1).cast("bigint")})
    return (
        segments.withColumn("_pack", _numbers_udf(cap)("_lens", "load", "pack"))
        .select(*key, "seg", F.inline(F.arrays_zip("_items", "_pack")))
        .select(*key, "seg", *[F.col(f"_items.{c}").alias(c) for c in rest], F.col("_pack").alias("pack"))
    )
