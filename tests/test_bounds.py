"""No caps: many results of a question, wide vectors, keys without an order; the encoder sees the added words."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.functions.joins import HOT, MAX_ROWS, counted_join, guarded_join
from docquarry.operators import evaluate as E
from docquarry.operators import index as X
from docquarry.sources import tables as B


def test_duplicates_of_five_thousand_results(spark):
    rows = spark.range(5000).select(F.lit("q").alias("query_id"), F.col("id").alias("rank"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("w"), F.when(k < 18, F.floor(F.col("id") / 2) * 100).otherwise(F.col("id") * 7) + k))).alias("text"))
    got = E.near_duplicates(rows).first()
    assert (got.results, got.duplicate_pairs) == (5000, 0)
    twins = rows.withColumn("text", F.regexp_replace("text", r" w\S+ w\S+$", ""))
    assert E.near_duplicates(twins).first().duplicate_pairs == 2500


def test_duplicates_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(q), r, " ".join(f"word{w}" for w in rng.choice(24, rng.integers(0, 24), replace=False))) for q in range(3) for r in range(60)]
    sets = [(q, r, set(t.split())) for q, r, t in rows]
    want = {q: sum(1 for a in sets for b in sets if a[0] == b[0] == q and a[1] < b[1] and a[2] and b[2] and len(a[2] & b[2]) > 0.5 * len(a[2] | b[2])) for q in range(3)}
    df = spark.createDataFrame(rows, "query_id int, rank int, text string")
    assert {r.query_id: r.duplicate_pairs for r in E.near_duplicates(df, 0.5).collect()} == want


def test_wide_vectors_make_many_slices():
    assert X.query_slices(100, 1000) == 1 and X.query_slices(0, 0) == 1
    assert X.query_slices(20_000, 1000) >= 2 and X.query_slices(100, 10 * X.MAX_QUERY_BYTES) >= 10


def test_slices_give_the_same_neighbours(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(f"c{i}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(400)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(50)], "query_id long, embedding array<float>")
    one, many = (sorted(map(tuple, X.nearest(v, q, 7, m).collect())) for m in (1000, 9))
    assert one == many and len(one) == 350
    c, rows = v.collect(), {}
    for r in q.collect():
        best = sorted(((-float(np.dot(r.embedding, x.embedding)), x.chunk_id) for x in c))[:7]
        rows.update({(r.query_id, i): s for s, i in best})
    assert {(a, b) for a, b, *_ in one} == set(rows)


@pytest.mark.parametrize("seq", [False, True])
def test_upsert_keeps_one_row_per_key(spark, seq):
    old = spark.createDataFrame([("a", 0), ("z", 0)], "chunk_id string, x int")
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("b", 3, 2)], "chunk_id string, x int, _seq int")
    got = {r.chunk_id: r.x for r in B.upsert(old, new if seq else new.drop("_seq")).collect()}
    assert set(got) == {"a", "b", "z"} and got["a"] == 1 and (got["b"] == 3 or not seq)
    assert B.upsert(old, new if seq else new.drop("_seq")).count() == 3


def test_encoder_sees_the_words_added_to_an_administrative_question(spark):
    from docquarry.operators.retrieve import SearchConfig, search
    rows = [(str(i), f"text number {i} about things", f"f{i}.txt", f"d{i}", 100, "sbi", "health", 1, i, None, None, vec) for i, vec in enumerate(([1.0, 0.0], [0.0, 1.0]))]
    chunks = spark.createDataFrame(rows, "chunk_id string, page_content string, filename string, document_id string, document_priority int, carrier string, "
                                         "line_of_business string, page_number int, chunk_index int, previous_chunk_id string, next_chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, "which documents and forms are required for a claim")], "query_id long, query string")
    seen = []

    def encode(df):
        seen.extend(r.search_query != r.query for r in df.select("query", "search_query").collect())
        added = F.col("search_query") != F.col("query")
        return df.withColumn("embedding", F.when(added, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>"))

    search(chunks, asked, SearchConfig(), encode=encode).count()
    assert seen == [True]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_copies_are_not_broadcast(spark):
    """Spark estimates the copies at the size of one: 0.8 MB here, and 51 MB when they are made."""
    big, small = spark.range(10), spark.range(MAX_ROWS + 1)
    assert "Broadcast" not in plan_of(guarded_join(big, small, ["id"], spread=F.col("id")))
    assert guarded_join(big, small, ["id"], spread=F.col("id")).count() == 10


@pytest.mark.parametrize("how", ["inner", "left"])
def test_counted_join_copies_hot_keys_only(spark, how):
    big = spark.range(3 * HOT).select(F.when(F.col("id") < 2 * HOT, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("o"))
    small = big.filter("k % 3 = 0").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") + 1)
    got = counted_join(big, small, ["k"], "n", F.col("o"), how)
    want = big.join(small.drop("n"), ["k"], how).select(got.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert plan_of(got).count("BroadcastExchange") == 1  # the hot keys
