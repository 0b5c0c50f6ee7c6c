"""Fuzzy names against plain loops."""
import random

from pyspark.sql import functions as F

from docquarry.functions import similarity as Y


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a, b, threshold=0.0):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    best = max(ratio(a, b[max(0, i):i + len(a)]) for i in range(1 - len(a), len(b)))
    return best if best >= threshold else 0.0


def fuzzy_carrier(words, aliases, threshold):
    best, value = None, 0.0
    for w in words:
        for name, alias in aliases:
            if ratio(alias, w) > value:
                best, value = name, ratio(alias, w)
    return best if value >= threshold else None


def fuzzy_lob(q, lobs, threshold, least):
    words = [(kw, lob) for lob, kws in lobs for kw in kws if len(kw) >= least]
    score, _, lob = max(((partial_ratio(kw, q, threshold), len(kw), lob) for kw, lob in words), key=lambda t: t[:2])
    return lob if score >= threshold else None


def edited(rng, word):
    for _ in range(rng.randint(0, 3)):
        k = rng.randint(0, len(word))
        word = rng.choice((word[:k] + rng.choice("aeinrst") + word[k:], word[:k] + word[k + 1:]))
    return word


def test_ratios(spark):
    rng = random.Random(4)
    texts = ["", "a", "retirement", "retirment plan", "étage", "日本語 text"] + ["".join(rng.choices("abcr et", k=rng.randint(0, 25))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for word in ("retirement", "abc", "r", "étage", "ter bac eta bcr"):
        got = {r.i: r for r in df.select("i", Y.ratio(word, F.col("t")).alias("r"), Y.partial_ratio(word, F.col("t")).alias("p"),
                                         Y.partial_ratio(word, F.col("t"), 70.0).alias("q")).collect()}
        for i, t in enumerate(texts):
            assert abs(got[i].r - ratio(word, t)) < 1e-9
            assert abs(got[i].p - partial_ratio(word, t)) < 1e-9, (word, t)
            assert abs(got[i].q - partial_ratio(word, t, 70.0)) < 1e-9, (word, t)


def test_names(spark):
    rng = random.Random(5)
    aliases = (("A", "saral"), ("B", "sarala"), ("C", "source1"), ("D", "source12"), ("E", "xy"))
    lobs = (("health", ("medical", "hospital", "ill")), ("life", ("retirement", "hospitals")), ("home", ("building cover",)))
    names, keys = [a for _, a in aliases], [k for _, ks in lobs for k in ks]
    rows = [(i, [edited(rng, rng.choice(names)) for _ in range(rng.randint(0, 6))], " ".join(edited(rng, rng.choice(keys)) for _ in range(rng.randint(0, 4))))
            for i in range(150)] + [(150, None, None)]
    df = spark.createDataFrame(rows, "i int, words array<string>, q string")
    got = df.select("i", Y.fuzzy_carrier(F.col("words"), aliases, 85.0).alias("c"), Y.fuzzy_lob(F.col("q"), lobs, 85.0, 6).alias("l"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    have = {r.i: (r.c, r.l) for r in got.collect()}
    want = {i: (fuzzy_carrier(w, aliases, 85.0), fuzzy_lob(q, lobs, 85.0, 6)) for i, w, q in rows[:-1]}
    assert have == {**want, 150: (None, None)}
    assert len({c for c, _ in have.values()}) > 4 and len({x for _, x in have.values()}) == 4


def test_windows_of_long_texts(spark):
    """In long texts only the windows near a piece of the word are looked at; the best one is never left out, not where a
    piece stands at the start, overlaps itself or is found very often. Before, one text took as long as all its windows."""
    rng = random.Random(6)
    words = ("retirement", "personal accident", "aaabaaaa", "a.b*c(d)e", "xyxyxyxyxyxyxy")
    spice = lambda: rng.choice(("", "é", "日本", "a a a ", "xyxyx", " ", "(d)", "..."))
    texts = [edited(rng, w) + "".join(spice() + "".join(rng.choices("abcdeinrtp ", k=5)) for _ in range(12)) + edited(rng, w) + spice() for w in words for _ in range(12)]
    texts += ["a" * 100 + "aaabaaaa" + "a" * 90, "xy" * 120 + "x", "ab" * 90 + "aaabaaa" + "ab" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r[0]: r[1:] for r in df.select("i", *[Y.partial_ratio(w, F.col("t"), 85.0) for w in words]).collect()}
    for i, t in enumerate(texts):
        assert got[i] == tuple(partial_ratio(w, t, 85.0) for w in words), t
    assert len({x for r in got.values() for x in r}) > 8
    # windows that are looked at, of the 490 of this text
    k = Y._known([("retirement", "")], 85.0)[0]
    assert spark.range(1).select(Y._starts(k, F.lit("the quick brown fox " * 12 + "retiremint" + " and a dog" * 25))).first()[0] == [240, 241, 242]
