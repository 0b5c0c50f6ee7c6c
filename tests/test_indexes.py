"""Stored postings and vector cells."""
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docquarry.operators import cells as C
from docquarry.operators import index as X
from docquarry.operators.retrieve import search
from docquarry.registry.base import chunks, questions
from docquarry.registry.index import CONFIG
from docquarry.session import cut, fresh_path

SF = "/root/testdata/sf0.001"


def pairs(df):
    return sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 6)) for r in df.collect())


def vectors(spark, n=3000, dim=16, groups=40, seed=3):
    """Vectors around centres, one centre holding a third of them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    of = np.where(rng.random(n) < 0.33, 0, rng.integers(0, groups, n))
    v = centres[of] + 0.3 * rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"c{i:05d}", ("A", "B", "RARE")[0 if i % 7 else 1 + (i % 21 == 0 and i < 200)], None, x.tolist()) for i, x in enumerate(v)]
    return cut(spark.createDataFrame(rows, "chunk_id string, carrier string, line_of_business string, embedding array<float>").repartition(4))


def asked(v, every=60):
    number = F.substring("chunk_id", 2, 5).cast("long")
    return v.withColumn("query_id", number).filter(F.col("query_id") % every == 0).drop("chunk_id")


def test_cells_reach_the_recall(spark):
    v = vectors(spark)
    index = C.build_vector_index(v)
    q = asked(v).drop("carrier")
    probes = C.choose_probes(index, q)
    assert 1 <= probes < len(index.centres) // 3  # data with structure: few cells are enough
    found = C.nearest_in_cells(index, q, probes=probes)
    assert C.recall(found, X.nearest(v, q)) >= 0.9
    assert found.groupBy("query_id").count().filter("count != 25").isEmpty()


def test_all_cells_are_the_exact_search_whatever_the_blocks(spark, monkeypatch):
    v = vectors(spark, 900)
    monkeypatch.setattr(C, "BLOCK", 50)  # the hot cell makes several blocks on both sides
    index = C.build_vector_index(v, cells=6)
    q = asked(v, 3)
    assert pairs(C.nearest_in_cells(index, q, probes=6)) == pairs(X.nearest(v, q))


def test_a_query_goes_once_to_a_group_of_cells(spark, monkeypatch):
    """Before, to each of its cells, so that what was shuffled grew with queries times cells."""
    v = vectors(spark, 900)
    index = C.build_vector_index(v, cells=30)
    q = asked(v, 3)
    plain = pairs(C.nearest_in_cells(index, q, probes=20, complete=False))
    seen = []
    monkeypatch.setattr(C, "top_k", lambda df, *rest: seen.append(df.count()) or X.top_k(df, *rest))
    assert pairs(C.nearest_in_cells(index, q, probes=20, complete=False)) == plain
    assert seen[0] <= 25 * q.count()  # one group: one list of the best per query
    monkeypatch.setattr(C, "BLOCK", 50)
    assert pairs(C.nearest_in_cells(index, q, probes=20, complete=False)) == plain


def test_group_scores_are_those_of_plain_loops():
    rng = np.random.default_rng(3)
    scope = lambda n: rng.choice(np.array(["A", "B", None], dtype=object), n)
    v = pd.DataFrame({"chunk_id": [f"c{i % 70:02d}" for i in range(80)], "carrier": scope(80), "line_of_business": scope(80), "cell": rng.integers(0, 4, 80),
                      "embedding": list(rng.integers(-2, 3, (80, 3)).astype(float))})  # many equal scores, some names twice
    v.at[5, "embedding"] = np.array([np.nan, 0, 0])
    q = pd.DataFrame({"query_id": range(40), "carrier": scope(40), "line_of_business": scope(40), "embedding": list(rng.integers(-2, 3, (40, 3)).astype(float)),
                      "cells": [rng.permutation(4)[:2].astype(np.int32) for _ in range(40)]})
    for probing in (q, q.assign(cells=None)):
        got = C.group_scores(v, probing, 7)
        for a in probing.itertuples():
            fits = [b for b in v.itertuples() if (a.cells is None or b.cell in a.cells) and not np.isnan(b.embedding).any()
                    and a.carrier in (None, b.carrier) and a.line_of_business in (None, b.line_of_business)]
            best = sorted((-round(float(a.embedding @ b.embedding), 9), b.chunk_id) for b in fits)[:7]
            mine = got[got["query_id"] == a.query_id]
            assert sorted(zip(-mine["score"], mine["chunk_id"])) == best


def test_rare_scopes_are_searched_exactly(spark):
    v = vectors(spark)
    index = C.build_vector_index(v)
    q = asked(v).withColumn("carrier", F.lit("RARE"))
    found = C.nearest_in_cells(index, q, probes=1)
    assert pairs(found) == pairs(X.nearest(v, q))
    few = C.nearest_in_cells(index, q, probes=1, complete=False)
    assert few.count() < found.count()


def test_stored_cells_are_pruned_and_equal(spark):
    v = vectors(spark, 900)
    index = C.build_vector_index(v, cells=12)
    path = fresh_path(spark, "cells")
    C.write_vector_index(index, path)
    stored = C.read_vector_index(spark, path)
    assert np.allclose(stored.centres, index.centres)
    q = asked(v, 300).drop("carrier")
    assert pairs(C.nearest_in_cells(stored, q, probes=2, complete=False)) == pairs(C.nearest_in_cells(index, q, probes=2, complete=False))


def test_cells_of_odd_tables(spark):
    v = vectors(spark, 50)
    none = C.build_vector_index(v.limit(0))
    assert C.nearest_in_cells(none, asked(v)).count() == 0
    index = C.build_vector_index(v.withColumn("embedding", F.when(F.col("chunk_id") != "c00001", F.col("embedding"))))
    assert index.vectors.count() == 49
    assert C.nearest_in_cells(index, asked(v, 10).limit(0)).count() == 0
    twice = asked(v, 10)
    assert C.nearest_in_cells(index, twice, k=3).count() == 3 * twice.count()


def test_search_with_a_vector_index(spark):
    c = cut(chunks(spark, SF, vectors=True))
    q = questions(spark, SF, vectors=True)
    embedded = c.filter("embedding IS NOT NULL")
    index = C.build_vector_index(embedded)
    order = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in df.collect())
    exact = search(c, q, CONFIG)
    whole = C.VectorIndex(index.vectors, index.centres[:1])  # a single cell
    whole = C.VectorIndex(whole.vectors.withColumn("cell", F.lit(0)), whole.centres)
    assert order(search(c, q, CONFIG, vector_index=whole)) == order(exact)
    assert search(c, q, CONFIG, vector_index=index).select("query_id").distinct().count() == exact.select("query_id").distinct().count()


def test_stored_postings_equal_and_prune(spark):
    c = cut(chunks(spark, SF))
    built = X.build_index(c)
    path = fresh_path(spark, "index")
    X.write_index(built, path)
    stored = X.read_index(spark, path)
    q = spark.createDataFrame([(1, "the thin", None, None), (2, "onnthe", "SRC3", None)], "query_id long, search_query string, carrier string, line_of_business string")
    score = lambda i: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in X.scoped_bm25_scores(i, q).collect())
    assert score(stored) == score(built) and score(stored)
    plan = X.scoped_bm25_scores(stored, q)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    # folders of other terms are not read, and other terms are gone before the exchange by chunk
    scan = next(x for x in lines if "postings" in x and "FileScan" in x)
    assert re.search(r"PartitionFilters: \[bucket#\d+ (IN|INSET)", scan)
    at = {k: next(i for i, x in enumerate(lines) if k in x) for k in ("Exchange hashpartitioning(chunk_id", "LeftSemi")}
    assert at["Exchange hashpartitioning(chunk_id"] < at["LeftSemi"] < lines.index(scan)
    assert sum("Exchange hashpartitioning" in x and "chunk_id" in x for x in lines) == 1  # no pairs are shuffled
