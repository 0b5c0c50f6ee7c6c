"""Ranked search, language and whitening: brute force, held-out accuracy and odd inputs."""
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import SCHEMA, SF, lower, odd, plain  # noqa: F401
from tests.oracle import compare, duck


# --- ranked lexical search ------------------------------------------------------
def words_of(text):
    out, word = [], ""
    for c in lower(text or ""):
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 0x80:
            word += c
        else:
            out, word = out + [word] * bool(word), ""
    return out + [word] * bool(word)


def ranked(docs, items, k=20):
    """Scores of all documents, by the contract and nothing else."""
    split = [(i, words_of(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, w in split if w), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for i, w in split:
            tf, score = Counter(w), 0
            m = 100 - 25 + (25 * len(w) * n_docs) // max(n_terms, 1)
            for t in words_of(text):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is not None, i))
        out += [[item, r, i, -s] for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_search_sql(spark):
    from docquarry.llm.lexical import SQL, op12
    assert compare(spark, duck(SF), SF, op12, SQL) == (800, "")


def test_search_odd(spark, odd):  # noqa: F811
    from docquarry.llm.lexical import search
    items = [(1, None), (2, ""), (3, " ,.- "), (4, "w1 w2 W3 w1"), (5, "日本🙂 x"), (6, "unknown"), (7, "w5 " * 400), (7, "w5 " * 400), (None, "w9 w10")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "rank", "score", "n", "a.b")})
    for k in (20, 3):
        want = ranked([(r.doc_id, r.text) for r in odd.collect()], items, k)
        assert plain(search(odd, asked, k), "item", "rank", "id", "score") == want
    assert search(odd.limit(0), asked).count() == search(odd, asked.limit(0)).count() == 0


def test_search_in_blocks_of_items(spark, odd, monkeypatch):  # noqa: F811
    from docquarry.llm import lexical
    asked = spark.createDataFrame([(i, f"w{i} w{i + 7} w{3 * i}") for i in range(9)], "item_id long, text string")
    whole = plain(lexical.search(odd, asked), "item", "rank", "id", "score")
    monkeypatch.setattr(lexical, "ITEMS", 4)
    assert plain(lexical.search(odd, asked), "item", "rank", "id", "score") == whole


def test_first_bounds_change_nothing(spark, monkeypatch):
    from docquarry.llm import lexical
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = plain(lexical.search(docs, items), "item", "rank", "id", "score")
    monkeypatch.setattr(lexical, "SEEDS", 40)  # 200 documents: the sample is searched first
    assert plain(lexical.search(docs, items), "item", "rank", "id", "score") == whole


def segment(rng, topics=6, size=400):
    """Documents on topics, so that lists have parts that are alike."""
    from docquarry.llm.lexical import Segment
    rows = []
    for i in range(size):
        own = [t * 50 + int(x) for t in (i % topics,) for x in rng.zipf(1.5, 30) % 50]
        rows.append(Counter(own + [int(x) for x in 300 + rng.zipf(1.3, 20) % 40]))
    batch = pa.record_batch([pa.array(rng.permutation(size)), pa.array([sum(r.values()) for r in rows], pa.int64()),
                             pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))],
                            names=["id", "n", "terms", "tf"])
    return Segment(batch, size, 50 * size)


def test_block_bounds_hold_and_skip():
    rng = np.random.default_rng(5)
    s = segment(rng)
    skipped = 0
    for column in range(len(s.names)):
        members, starts = s.blocks(column)
        assert sorted(members) == np.flatnonzero(s.values[:, column]).tolist()  # every document of the list is in one block
        ends = np.append(starts[1:], len(members))
        assert (ends - starts).max() <= 64
        assert len({*members[starts]}) == len(starts)
    for _ in range(60):
        names = np.unique(rng.choice(s.names, 6))
        weights = rng.integers(1, 9000, len(names)).astype(float)
        all_scores = s.values[:, np.searchsorted(s.names, names)].astype(np.float64) @ weights
        for floor in (1, int(np.sort(all_scores)[-40])):
            want = sorted(((-x, p) for p, x in enumerate(all_scores) if x >= floor and x > 0))[:20]
            [(q, places, scores)] = list(s.search([(names, weights)], 20, [floor])) or [(0, [], [])]
            assert sorted((-x, p) for p, x in zip(places, scores))[:len(want)] == want
            skipped += len(places) < (all_scores > 0).sum() / 2
    assert skipped > 60  # most documents are never scored


# --- language -------------------------------------------------------------------
def test_language_held_out_accuracy(spark):
    from docquarry.llm.language import op11
    sf = "/root/testdata/sf0.01"
    got = op11(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*"), F.min("score"), F.max("score")).first()
    assert right[0] >= 0.98 and right[1] > 200 and 0 <= right[2] <= right[3] <= 1


def test_language_learns_from_the_others_only(spark):
    from docquarry.llm.language import held_out, predict_language
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lied = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert plain(predict_language(docs), "id", "lang_pred", "score") == plain(predict_language(lied), "id", "lang_pred", "score")


def test_language_odd(spark, odd):  # noqa: F811
    from docquarry.llm.language import predict_language
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    known = docs.withColumns({c: F.lit(1) for c in odd.columns if c not in docs.columns})
    got = predict_language(known.unionByName(odd.withColumn("doc_id", F.col("doc_id") - 1000))).filter("id < 0 OR id IS NULL")
    rows = {(r.id, r.lang_pred) for r in got.collect()}
    assert got.count() == odd.count() and {(-999, "und"), (-998, "und"), (-997, "und")} <= rows
    assert all(r.lang_pred in ("de", "en", "es", "fr", "und") and 0 <= r.score <= 1 for r in got.collect())
    assert predict_language(odd.limit(0)).count() == 0
    nothing = predict_language(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(nothing) == odd.count() and {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}
    numbered = predict_language(spark.createDataFrame([("k1", "alpha beta gamma", "x")], "doc_id string, text string, lang string"))
    assert numbered.columns == ["id", "held_out", "lang_pred", "score"] and numbered.count() == 1


def plain_ngrams(text):
    out = {3: [], 4: []}
    codes = [ord(c) if c.isalpha() else 0 for c in "\n" + text.lower() + "\n"]
    for size in out:
        for i in range(len(codes) - size + 1):
            if all(codes[i + 1:i + size - 1]):
                out[size].append(tuple(codes[i:i + size]))
    return out


def test_ngrams_are_those_of_a_plain_loop():
    from docquarry.llm.language import ngrams
    rng = random.Random(2)
    parts = ["", "a", "Über", "x y", "日本語🙂", "ab12cd", *("".join(rng.choice("abÉ 9\n") for _ in range(30)) for _ in range(40))]
    want = [plain_ngrams(p) for p in parts]
    for size, (grams, ends) in zip((3, 4), ngrams(parts)):
        name = {}
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            assert b - a == len(want[k][size])
            assert all(name.setdefault(g, h) == h for g, h in zip(want[k][size], grams[a:b].tolist()))
        assert len(set(name.values())) == len(name)


def test_filters_find_all_languages_and_take_false_ones_off(spark):
    from docquarry.llm.language import HASHES, SLOTS, Filters, ngrams
    rng = random.Random(8)
    vocab = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(1000)] for _ in range(70)]
    slots, words, masks = [], [], []
    for k in (0, 1, 66):  # 70 languages need two words a row
        for grams, _ in ngrams([" ".join(vocab[k])]):
            for h in range(HASHES):
                s = np.unique((grams >> np.uint64(20 * h)).astype(np.int64) & (SLOTS - 1))
                slots, words, masks = slots + [s], words + [np.full(len(s), k // 64)], masks + [np.full(len(s), 1 << (k % 64), np.uint64)]
    order = np.concatenate(slots), np.concatenate(words), np.concatenate(masks)
    merged = {}
    for s, w, m in zip(*(x.tolist() for x in order)):
        merged[s, w] = merged.get((s, w), 0) | m
    at = np.array(list(merged))
    filters = Filters([f"l{k}" for k in range(70)], at[:, 0], at[:, 1], np.array(list(merged.values()), np.uint64))
    mine = [" ".join(vocab[k][:50]) for k in (0, 1, 66)] + [" ".join(vocab[7][:50])]
    total, hits = filters.count(mine)
    assert all(hits[i, k] == total[i] for i, k in enumerate((0, 1, 66)))  # none is missed
    best, share = filters.decide(total, hits)
    assert best[:3].tolist() == [0, 1, 66] and (share[:3] > 0.4).all()
    assert filters.false[7] == 0 and 0 < filters.false[0] < 0.2


def test_long_texts_are_counted_whole():
    from docquarry.llm.language import PART, Filters
    none = Filters(["a"], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    text = "word " * (PART // 2)
    total, hits = none.count([text, "", "one"])
    assert abs(total[0] - (PART // 2) * 7) < 100 and total[1] == 0 and total[2] == 5 and not hits.any()


# --- whitening ------------------------------------------------------------------
def whitened(spark, rows, **columns):
    from docquarry.llm.whitening import whiten
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "vec", "w", "k", "d", "a.b")})
    return whiten(df, **columns).collect()


def test_whitening_against_plain_integers(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 11)) * np.arange(1, 12), rng.normal(size=(5, 11))])
    x[:, 4] = 2.5  # no variance
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = whitened(spark, [*rows, (900, None), (901, [1.0] * 10 + [None]), (902, [float("nan")] * 11), (903, [float("inf")] + [0.0] * 10),
                           (904, [1.0, 2.0]), (905, []), (906, [1e300] * 11)])
    ints = [[math.floor(1024 * c) + 100_000 for c in v] for v in x.tolist()]
    n, sums = len(ints), [sum(c) for c in zip(*ints)]
    v = np.array([[(n * sum(a[i] * a[j] for a in ints) - sums[i] * sums[j]) / n ** 2 for j in range(11)] for i in range(11)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    by = {(r.id, r.component): r for r in got}
    assert len(by) == len(got) == 8 * n and {r.n for r in got} == {n}
    want = np.array([[(n * c - s) / n for c, s in zip(a, sums)] for a in ints]) @ u / np.sqrt(e)
    for k in range(8):
        have = np.array([by[i, k + 1].whitened for i in range(n)])
        assert min(np.abs(have - want[:, k]).max(), np.abs(have + want[:, k]).max()) < 1e-8
        assert by[0, k + 1].explained == pytest.approx(e[k] / np.trace(v), rel=1e-9)
    assert all(by[i, 1].deviation == sum((n * c - s) ** 2 for c, s in zip(a, sums)) for i, a in enumerate(ints))
    w = np.array([[by[i, k + 1].whitened for k in range(8)] for i in range(n)])
    assert got[0].identity_error < 1e-9 and np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-9


def test_whitening_odd(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None)]) == []
    one = whitened(spark, [(1, [1.0, 2.0])])
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None), (2, 0, None, 0.0, None)]
    same = whitened(spark, [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [0.5, 3.0])])
    assert len(same) == 6 and {r.n for r in same} == {3} and same[0].identity_error < 1e-9
    assert {r.whitened is None for r in same if r.component == 2} == {True}  # three points on a line


def test_cross_products_of_wide_numbers():
    from docquarry.llm.whitening import cross_products
    rng = np.random.default_rng(1)
    for widths in ([3, 0, 9, 1], [40, 62, 7, 31]):
        y = np.stack([rng.integers(0, 1 << w, 131) if w else np.zeros(131, np.int64) for w in widths], 1)
        got = cross_products(y.astype(np.uint64), widths)
        for i in range(4):
            for j in range(i, 4):
                assert got[i, j] == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j]))
