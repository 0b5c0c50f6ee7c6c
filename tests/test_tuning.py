"""Rerank features, weight grid, duplicate texts of a corpus, numbered children, windows of percentiles."""
import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

from docquarry.functions.scan import with_segments
from docquarry.operators import chunks as K
from docquarry.operators import evaluate as E
from docquarry.streaming import monitor as M
from docquarry.session import fresh_path, shared_dir


def test_weight_grid_ranks_long_queries_like_short_ones(spark):
    rng = random.Random(5)
    rows = [(q, p, *[rng.choice((0.0, 0.25, 0.5, 1.0)) for _ in range(4)], rng.choice((1.0, 1.25)), rng.choice((0.5, 1.0)), rng.random() < share)
            for q, n, share in ((1, 300, 0.02), (2, 7, 0.3), (3, 65, 0.0), (4, 40, 1.0), (5, 33, 0.1)) for p in range(1, n + 1)]
    features = spark.createDataFrame(rows, "query_id int, position int, rrf double, meta_score double, specificity double, coverage double, boost double, penalty double, hit boolean")
    items = spark.createDataFrame([(q,) for q in range(6)], "query_id int")
    grid = E.weight_grid(0.25)
    for block in (8, 64, 4096):
        got = {(r["w1"], r["w2"], r["w3"], r["w4"]): r["mrr"] for r in E.grid_search(features, items, k=6, step=0.25, block=block).collect()}
        assert len(got) == len(grid) == 35
        for w in grid:
            total = 0.0
            for q in range(6):
                scored = sorted((-round(float(np.dot(w, r[2:6])) * r[6] * r[7], 9), r[1], r[8]) for r in rows if r[0] == q)
                first = next((i for i, s in enumerate(scored, 1) if s[2]), 99)
                total += 1 / first if first <= 6 else 0
            assert abs(got[tuple(round(float(x), 2) for x in w)] - total / 6) < 2e-6
    assert {r["mrr"] for r in E.grid_search(features.limit(0), items, step=0.5).collect()} == {0.0}


def features(spark, **values):
    row = dict(query="does acme cover teeth", policy="acme smile", intent="general", section_title="", heading_path="", clause_type="", carrier="", product_name="",
               document_type="", page_number=1, section_id="", heading_confidence=None, semantic_type="", document_priority=None, page_content="teeth")
    row.update(values)
    types = {"page_number": "int", "heading_confidence": "double", "document_priority": "double"}
    schema = ", ".join(f"{k} {types.get(k, 'string')}" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema)


def test_routing_words(spark):
    penalty = lambda known=(), **values: E.rerank_features(features(spark, **values), known_carriers=known).first()["penalty"]
    assert [penalty(policy=p) for p in (None, "", " ")] == [1.0] * 3
    assert penalty(product_name="Smile plan") == 2.0
    assert penalty(product_name="", product="Smile plan") == 2.0  # the other name of the product
    assert penalty(product_name="Other", product="Smile plan") == 1.0  # only where there is none
    assert penalty(policy="what if", product_name="what else") == 2.0  # question words count here
    assert penalty(policy="policy wording", product_name="policy wording") == 1.0
    assert penalty(known=("Acme Insurance",), policy="zeta", carrier="zeta") == 2.0
    assert penalty(known=("Acme Insurance",), policy="zeta", carrier="iota") == 0.1
    assert penalty(known=("Acme Insurance",), policy="zeta", carrier="acme") == 1.0
    assert penalty(known=("A B", "policy"), policy="zeta", carrier="iota", query="a b policy") == 1.0  # no word of three characters


def test_duplicate_texts_of_a_corpus(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] + ["common", "plain"] * 2
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            near = list(words)
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    texts += [" ".join(reversed(texts[0].split())), texts[0].upper(), "", None, "a b", "one two three", "one two three"] + ["hot text of many rows"] * 200
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, w string")
    member, pairs = E.corpus_duplicates(df, "id")
    sets = [frozenset(re.findall(r"\w{3,}", (t or "").lower())) for t in texts]
    least = {}
    for i, s in enumerate(sets):
        least.setdefault(s, i)
    assert dict(map(tuple, member.collect())) == {i: least[s] for i, s in enumerate(sets)}
    kinds = sorted(least.items(), key=lambda x: x[1])
    want = {(i, j): len(a & b) / len(a | b) for a, i in kinds for b, j in kinds if i < j and a and b and len(a & b) / len(a | b) > 0.85}
    got = {(r["class_a"], r["class_b"]): r["similarity"] for r in pairs.collect()}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    member, pairs = E.corpus_duplicates(df.limit(0), "id")
    assert member.count() == pairs.count() == 0


def test_duplicate_texts_in_shares(spark, monkeypatch):
    """Words put in order for a share of the classes at a time give the pairs of all at once; null and repeated ids too."""
    rng = random.Random(9)
    texts = [" ".join(f"word{rng.randrange(200)}" for _ in range(30)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " more") for i, t in enumerate(texts[:20])] + [(None, texts[0] + " none"), (None, None), (7, texts[9] + " two words")]
    df = spark.createDataFrame(rows, "id long, text string")
    once = [sorted(map(str, f.collect())) for f in E.corpus_duplicates(df, "id", "text")]
    before = set(os.listdir(shared_dir(spark)))
    monkeypatch.setattr(E, "SHARE", 500)
    many = [sorted(map(str, f.collect())) for f in E.corpus_duplicates(df, "id", "text")]
    left = [name.split("-")[0] for name in set(os.listdir(shared_dir(spark))) - before]
    assert once == many and len(once[1]) >= 21 and left.count("word_heads") > 2


def test_children_are_numbered_over_pages(spark):
    rows = [(d, p, f"# H{p}\n" + "text " * (60 * ((p * 7) % 5)) + f"\n## S{p}\nend") for d in "ab" for p in range(1, 8)] + [("c", 1, None), ("c", 2, "x"), ("d", 1, "")]
    pages = spark.createDataFrame(rows, "document_id string, page int, text string")
    want = K.parent_children(with_segments(pages)).collect()
    for d in "abcd":
        mine = sorted((r for r in want if r["document_id"] == d), key=lambda r: (r["page"], r["parent_no"], r["child_no"]))
        assert [r["chunk_index"] for r in mine] == list(range(len(mine)))
        assert [r["chunk_id"] for r in mine] == [f"{d}_{i}" for i in range(len(mine))]
    assert sum(r["document_id"] == "a" for r in want) > 14 and [r["child_text"] for r in want if r["document_id"] == "c"] == ["x"]
    cut_up = K.parent_children(with_segments(pages, 2), segmented=True).collect()
    assert sorted(map(tuple, cut_up)) == sorted(map(tuple, want))


def test_report_rows_without_answers(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    results = spark.createDataFrame([(1, 2, "HIGH", "f", 3), (1, 1, "MEDIUM", "g", 4)], "query_id int, rank int, confidence_tier string, filename string, page_number int")
    answers = spark.createDataFrame([(2, 1.5, True, "text", None)], "query_id int, latency_ms double, generation_degraded boolean, answer string, confidence_tier string")
    got = {r["query_id"]: r for r in E.query_report(queries, results, answers).collect()}
    assert (got[1]["confidence_tier"], got[1]["latency_ms"], got[1]["retrieved_chunks_count"]) == ("MEDIUM", None, 2)
    assert [tuple(c) for c in got[1]["citations"]] == [("g", 4), ("f", 3)]
    assert (got[2]["confidence_tier"], got[2]["latency_ms"], got[2]["generation_degraded"], got[2]["answer"]) == ("LOW", 1.5, True, "text")


def test_window_percentiles_merge(spark):
    arriving, out, check = (fresh_path(spark, n) for n in ("in", "out", "check"))
    rng = random.Random(4)
    rows = [(f"2024-01-01 {h:02d}:{rng.randint(0, 59):02d}:00", rng.choice("AB"), rng.lognormvariate(3, 1)) for h in range(4) for _ in range(300)] + [("2024-01-02 00:00:00", "A", 1.0), ("2024-01-01 01:00:00", "A", None)]
    log = spark.createDataFrame(rows, "ts string, confidence_tier string, latency_ms double")
    log.write.parquet(arriving)
    M.start_sketches(spark.readStream.schema(log.schema).parquet(arriving), out, check).awaitTermination()
    for keys, name in ((("window_start", "confidence_tier"), lambda r: (r["window_start"].hour, r["confidence_tier"])), (("confidence_tier",), lambda r: r["confidence_tier"])):
        for r in M.read_percentiles(spark, out, *keys).collect():
            mine = sorted(v for t, c, v in rows if v is not None and t < "2024-01-02" and ((int(t[11:13]), c) if len(keys) == 2 else c) == name(r))
            for share in (50, 95, 99):
                true = mine[-(-share * len(mine) // 100) - 1]
                assert abs(r[f"p{share}"] - true) <= 0.0101 * true


def test_corpus_duplicates_meet_by_rare_words(spark, monkeypatch):
    """Words that the fewest classes have come first: texts that share some words of few others do not meet by these."""
    texts = [(i, " ".join([*(f"own{i}x{j}" for j in range(12)), *(f"few{(i * 7 + j * 131) // 3 % 997}y{j}" for j in range(6))])) for i in range(3000)]
    texts += [(5000 + i, texts[i][1] + " more") for i in range(5)]
    met, meeting = [], E._meeting
    monkeypatch.setattr(E, "_meeting", lambda *a: met.append(meeting(*a)) or met[-1])
    df = spark.createDataFrame(texts, "id long, text string")
    pairs = E.corpus_duplicates(df, "id", "text")[1].collect()
    assert {(r["class_a"], r["class_b"]) for r in pairs} == {(i, 5000 + i) for i in range(5)}
    assert met[0].count() <= 10
    # what follows the first common word is too short in both
    sets = spark.createDataFrame([(1, list("abcdefghij"), 10), (2, list("xyclmnopqr"), 10), (3, list("abcdefghix"), 10)], "class_id long, w array<string>, n int")
    assert [tuple(r) for r in meeting(sets, [], "class_id", 0.8).collect()] == [(1, 3)]
