import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docquarry.functions import joins as J
from docquarry.functions import similarity as Y
from docquarry.operators import index as X
from docquarry.operators import retrieve as R


def test_fuzzy_names(spark):
    df = spark.createDataFrame([("what does the hdfcc plan say",), ("saral suraksha byma cover",), ("corana rakshak limits",), ("nothing here",), (None,)], "q string")
    got = df.select(Y.fuzzy_carrier(X.tokens(F.col("q"))), Y.fuzzy_lob(F.col("q"))).collect()
    assert [r[0] for r in got] == ["HDFC", None, None, None, None]
    assert [r[1] for r in got][1:] == ["personal accident", "health", None, None]


def test_scope_detection(spark):
    df = spark.createDataFrame([(1, "What is covered under SBI Corona Rakshak policy?"), (2, "Compare SBI and HDFC term plans"),
                                (3, "What documents are required to file a death claim under HDFC?"), (4, "What is the capital of Mars?")], "query_id long, query string")
    got = [tuple(r) for r in R.detect_scope(df).orderBy("query_id").select("carrier", "line_of_business", "is_comparison", "is_admin").collect()]
    assert got == [("SBI", "health", False, False), (None, "protection", True, False), ("HDFC", None, False, True), (None, None, False, False)]


def test_fusion_ranks_from_zero(spark):
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, chunk_id string, rank int")
    sparse = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id long, chunk_id string, rank int")
    got = [(r["chunk_id"], r["rrf"]) for r in R.top_fused(R.fuse(dense, sparse)).orderBy("fused_rank").collect()]
    assert [g[0] for g in got] == ["b", "a", "c"]
    assert [g[1] for g in got] == pytest.approx([1 / 61 + 1 / 60, 1 / 60, 1 / 61])


def test_tiers(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([.4999, .50, .6999, .70])], "query_id long, score double")
    assert [tuple(r) for r in R.confidence_tier(df).orderBy("query_id").select("query_id", "confidence_tier").collect()] == [
        (1, "MEDIUM"), (2, "MEDIUM"), (3, "HIGH")]


def diversify_loop(docs, cap=3, k=5):
    count, chosen, over = {}, [], []
    for i, d in enumerate(docs):
        if count.get(d, 0) < cap:
            chosen.append(i)
            count[d] = count.get(d, 0) + 1
        else:
            over.append(i)
        if len(chosen) >= k:
            break
    while len(chosen) < k and over:
        chosen.append(over.pop(0))
    return chosen


def test_diversity_against_a_loop(spark):
    rng = random.Random(6)
    cases = [[rng.choice("abc") for _ in range(rng.randint(1, 15))] for _ in range(500)]
    data = [(q, i, 1.0 - i / 100, d) for q, c in enumerate(cases) for i, d in enumerate(c)]
    df = spark.createDataFrame(data, "query_id long, fused_rank int, score double, document_id string").withColumn("filename", F.col("document_id"))
    got = {}
    for r in R.diversify(df).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["fused_rank"])
    assert got == {q: diversify_loop(c) for q, c in enumerate(cases)}


def pack_loop(rows, budget):
    used, ids, out = 0, set(), []
    for cid, text, sid, stext in rows:
        n = max(1, len(text) // 4)
        if cid in ids or used + n > budget:
            continue
        used += n
        ids.add(cid)
        out.append(cid)
        if sid and sid not in ids and used + max(1, len(stext) // 4) <= budget:
            used += max(1, len(stext) // 4)
            ids.add(sid)
            out.append(sid)
    return out


def test_budget_against_a_loop(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(300):
        ids = rng.sample("abcdefgh", 5)
        cases.append([(c, "x" * rng.choice([0, 5, 40, 90]), rng.choice([None, *"abcdefgh"]), "y" * rng.choice([3, 40])) for c in ids])
    data = [(q, i, c, t, (s, y) if s else None) for q, rows in enumerate(cases) for i, (c, t, s, y) in enumerate(rows)]
    df = spark.createDataFrame(data, "query_id long, position int, chunk_id string, text string, sibling struct<chunk_id:string,page_content:string>").selectExpr(
        "*", "1D score", "1D semantic_score", "'HIGH' confidence_tier", "'d' document_id", "'f' filename", "1 page_number")
    got = {q: [] for q in range(len(cases))}
    for r in R.pack_context(df, 30).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["chunk_id"])
    assert got == {q: pack_loop(rows, 30) for q, rows in enumerate(cases)}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(600, 8)).astype(np.float32)
    v[100:110] = v[0]  # ties
    q = rng.normal(size=(15, 8)).astype(np.float32)
    vec = spark.createDataFrame(pd.DataFrame({"chunk_id": [f"c{i:03d}" for i in range(600)], "embedding": [list(map(float, x)) for x in v], "carrier": ["A" if i % 3 else "B" for i in range(600)]}))
    ask = spark.createDataFrame([(i, [float(x) for x in q[i]], [None, "A", "B"][i % 3]) for i in range(15)], "query_id long, embedding array<double>, carrier string")
    expect = set()
    for i in range(15):
        s = np.round(v.astype(float) @ q[i].astype(float), 9)
        ok = [j for j in range(600) if i % 3 == 0 or ("A" if j % 3 else "B") == [None, "A", "B"][i % 3]]
        for rank, j in enumerate(sorted(ok, key=lambda j: (-s[j], j))[:7], 1):
            expect.add((i, f"c{j:03d}", rank))
    for limit in (1000, 10):  # one slice; several slices
        got = {(r["query_id"], r["chunk_id"], r["rank"]) for r in X.nearest(vec.repartition(5), ask, 7, max_queries=limit).collect()}
        assert got == expect


def test_hot_key_join_both_ways(spark, monkeypatch):
    big = spark.range(3000).select((F.col("id") % 7 * 0).alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    want = big.count()
    assert J.guarded_join(big, small, ["k"]).count() == want
    monkeypatch.setattr(J, "is_small", lambda *_: False)
    joined = J.guarded_join(big, small, ["k"], spread=F.col("id"))
    assert joined.count() == want and set(joined.columns) == {"k", "id", "v"}
    assert J.guarded_join(big, small, ["k"], "left_semi", spread=F.col("id")).count() == want


def test_size_check(spark):
    assert J.is_small(spark.range(10)) and not J.is_small(spark.range(11), max_rows=10)
    assert not J.is_small(spark.range(10).withColumn("t", F.repeat(F.lit("x"), 100)), max_bytes=500)


def test_bm25_pairs_are_not_shuffled(spark):
    """Scores are complete per task: between the scores and the cut to the best
    there is one exchange, by query."""
    rest = [(f"r{i}", f"word{i} other{i}", "C", "L") for i in range(8)]
    c = spark.createDataFrame([("a", "one two three", "C", "L"), ("b", "two two four", "C", "L"), *rest], "chunk_id string, page_content string, carrier string, line_of_business string")
    q = spark.createDataFrame([(1, "two four")], "query_id long, search_query string")
    top = R.sparse_candidates(X.bm25_scores(c, q))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "hashpartitioning(query_id#" in plan
    assert not any("hashpartitioning(query_id" in line and "chunk_id" in line for line in plan.splitlines())
    assert top.orderBy("rank").first()["chunk_id"] == "b"


def test_scoped_statistics_without_ids(spark):
    """The statistics of scopes need no chunk ids."""
    c = spark.createDataFrame([("one two two", "A", "L"), ("two three", "A", "M"), ("", "B", "L")], "page_content string, carrier string, line_of_business string")
    got = {(r["carrier"], r["line_of_business"], r["term"]): r["df"] for r in X.scoped_term_stats(c).collect()}
    assert got["A", "L", "two"] == 1 and got["A", None, "two"] == 2 and got[None, None, "three"] == 1
    totals = X.scoped_corpus_stats(c).filter("carrier IS NULL AND line_of_business IS NULL").collect()
    assert (3, 5 / 3) in [(r["n"], r["avgdl"]) for r in totals]


def test_chunks_are_dealt_out_by_hits(spark, monkeypatch):
    """The tasks that score grow with the pairs of a query and a posting, not with the postings alone."""
    c = spark.createDataFrame([(f"c{i:02d}", f"common word{i} {'rare' if i < 3 else 'other'}", "C", "L") for i in range(40)],
                              "chunk_id string, page_content string, carrier string, line_of_business string")
    q = spark.createDataFrame([(i, "common rare", "C" if i % 2 else None, None) for i in range(10)], "query_id long, search_query string, carrier string, line_of_business string")
    rows = lambda df: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    searches = (lambda: X.bm25_scores(c, q), lambda: X.scoped_bm25_scores(X.build_index(c), q))
    for run in searches:
        want = rows(run())
        with monkeypatch.context() as patch:
            patch.setattr(X, "HITS_PER_TASK", 20)  # 10 queries meet 40 + 3 postings
            few = run()
            plan = few._jdf.queryExecution().executedPlan().toString()
            assert any("hashpartitioning(chunk_id" in line and ", 22)" in line for line in plan.splitlines())
            assert rows(few) == want and len(want) == 400
