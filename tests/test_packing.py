import random

from pyspark.sql import functions as F

from docquarry.functions.packing import greedy_packs


def loop(lengths, cap):
    out, pack, load = [], -1, 0
    for n in lengths:
        if load == 0 or load + n > cap:
            pack, load = pack + 1, 0
        load += n + 1
        out.append(pack)
    return out


def test_packs_against_a_loop(spark):
    rng = random.Random(2)
    cases = {k: [rng.choice([1, 3, 5, 9, 10, 11, 20, 30]) for _ in range(rng.randint(1, 40))] for k in range(400)}
    data = [(k, i, i // rng.randint(3, 3), n) for k, v in cases.items() for i, n in enumerate(v)]
    df = spark.createDataFrame(data, "k int, i int, seg int, n int")
    for segmented, items in ((True, df), (True, df.withColumn("seg", F.col("i"))), (False, df.withColumn("seg", F.lit(0)))):
        got = {}
        for r in greedy_packs(items, ["k"], ["i"], F.col("n"), 20, segmented).orderBy("k", "i").collect():
            got.setdefault(r["k"], []).append(r["pack"])
        assert got == {k: loop(v, 20) for k, v in cases.items()}


def test_exact_fit_and_one_over(spark):
    df = spark.createDataFrame([(0, 0, 0, 9), (0, 1, 0, 10), (1, 0, 0, 9), (1, 1, 0, 11), (2, 0, 0, 50)], "k int, i int, seg int, n int")
    got = [tuple(r) for r in greedy_packs(df, ["k"], ["i"], F.col("n"), 20).select("k", "i", "pack").orderBy("k", "i").collect()]
    assert got == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 1), (2, 0, 0)]
