"""Percentiles of the query log from sketches that merge."""
import math
import random

from pyspark.sql import functions as F

from docquarry.operators import answers as G


def test_percentiles_are_within_the_accuracy(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.choice("AB"), rng.choice((0.0, -3.0, rng.lognormvariate(4, 2), rng.expovariate(0.001)))) for _ in range(4000)]
    rows += [("x", "C", 7.5), ("y", "C", None), ("x", "D", None), ("x", None, 1e300), ("x", "E", float("nan"))]
    log = spark.createDataFrame(rows, "day string, tier string, latency_ms double")
    days = G.latency_sketch(log, "day", "tier")
    merged = G.merge_sketches(days, "tier")
    got = {r["tier"]: r for r in G.percentiles(merged, "tier").collect()}
    assert set(got) == {"A", "B", "C", None}
    for tier in ("A", "B", "C", None):
        values = sorted(max(v, 0.0) for _, t, v in rows if t == tier and v is not None)
        for share in (0.5, 0.95, 0.99):
            true = values[math.ceil(share * len(values)) - 1]
            assert abs(got[tier][f"p{round(100 * share)}"] - true) <= 0.0101 * true
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(map(tuple, G.latency_sketch(log, "tier").select("tier", "bucket", "n").collect()), key=repr)
    assert G.percentiles(G.latency_sketch(log.limit(0), "tier"), "tier").count() == 0
    assert merged.groupBy("tier").count().agg(F.max("count")).first()[0] < 2000  # rows grow with the range, not with the log
