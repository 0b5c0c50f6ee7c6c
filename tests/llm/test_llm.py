"""Operators for training data: contracts against brute force, and odd inputs."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a very long text, repeated rows, ties, and columns whose names operators use themselves."""
    words = [f"w{i}" for i in range(300)]
    rng = random.Random(3)
    text = " ".join(rng.choice(words) for _ in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t\n ", "en", "a", 6), (None, text, "en", "a", 1), (4, text, "en", "a", 1),
            (4, text, "en", "a", 1), (4, text + " x", "fr", None, 1), (5, "\n".join([text] * 40) + "  ", "en", "a", 1),
            (6, " ".join(rng.choice(words) for _ in range(40_000)), "de", "b", 1), (7, "ÀÉ日本🙂 <|endoftext|> ▁a  b", "es", "b", 1)]
    extra = ["id", "fingerprint", "row", "n_words", "shard", "size", "line", "key", "h", "bins", "stratum", "hits", "sequence_id", "_row", "a.b"]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in extra})


def plain(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=repr)


def test_token_counts(spark, odd):
    import sentencepiece
    from docquarry.llm.token_counts import token_counts
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = plain(token_counts(odd, path), "id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for r in odd.collect():
        n = len(model.encode(r.text or ""))
        want.append([r.doc_id, len((r.text or "").encode()), n, n > 4096])
    assert got == sorted(want, key=repr)
    assert token_counts(odd.limit(0), path).count() == 0


def test_tokens_of_random_texts():
    import sentencepiece
    from tokenizers import Tokenizer

    import docquarry.llm.vocab as vocab
    rng = random.Random(5)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "▁", "é", "ß", "İ", "Σ", "’", "'s", "''s", "1", "23", "½", "<|endoftext|>", "<s>", "日本", "🙂",
             "\x1c", "\x85", "\xa0", "THE", "!!", "...", "\x00", "ﬁ", "é"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["", " ", "a ", " a"]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    old, vocab.fragments.__defaults__ = vocab.fragments.__defaults__, (17,)
    try:
        assert vocab.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"), 500, 300).lengths(some) == [len(model.encode(t)) for t in some]
        ids = vocab.WordIds(public_tokenizers.path("word_bpe_49k.json"), 300).ids(some)
        assert [x.tolist() for x in ids] == [words.encode(t, add_special_tokens=False).ids for t in some]
    finally:
        vocab.fragments.__defaults__ = old


def test_simhash(spark, odd):
    from docquarry.llm.simhash import simhash_components
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd.select(*[c.split()[0] for c in SCHEMA.split(", ")]))

    def fingerprint(text):
        w = re.findall(SPACE, lower(text or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, f in rows:
        if i is not None:
            root = find(parent, f)
            least[root] = min(least.get(root, i), i)
    want = Counter((i, f, least[find(parent, f)]) for i, f in rows)
    got = Counter((r.id, r.fingerprint % (1 << 64), r.component_id) for r in simhash_components(docs).collect())
    assert got == want
    assert simhash_components(docs.limit(0)).count() == 0


def test_simhash_entries_are_not_broadcast(spark):
    """66 entries of a fingerprint are made at once; Spark estimates them at the size of one."""
    from docquarry.llm.simhash import close_pairs

    prints = spark.range(1000).select(F.xxhash64("id").alias("fingerprint"))
    assert "Broadcast" not in close_pairs(prints)._jdf.queryExecution().executedPlan().toString()


def test_simhash_links_at_three_bits(spark):
    from docquarry.llm.simhash import close_pairs
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in list(values):
        values += [v ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 4)]
    values = list({v - (1 << 64) if v >> 63 else v for v in values})
    want = {(min(a, b), max(a, b)) for i, a in enumerate(values) for b in values[:i] if bin((a ^ b) % (1 << 64)).count("1") <= 3}
    got = [(r.a, r.b) for r in close_pairs(spark.createDataFrame([(v,) for v in values], "fingerprint long")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_components(spark):
    from docquarry.llm.common import components
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000 + rng.randint(0, 80), 1000 + rng.randint(0, 80)) for _ in range(60)] + [(5000, 5000 + i) for i in range(200)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for x in parent if x not in loops}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rules_counts(spark, odd):
    from docquarry.llm.rules import measured

    def brute(text):
        w, g, hit = re.findall(SPACE, text), Counter(), set()
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        g.update(windows)
        for i, x in enumerate(windows):
            if g[x] > 1:
                hit.update(range(i, i + 5))
        seen, twice = set(), 0
        for line in text.split("\n"):
            if re.search(SPACE, line):
                twice += line in seen
                seen.add(line)
        return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(hit)]

    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd.select(*[c.split()[0] for c in SCHEMA.split(", ")]))
    got = plain(measured(docs), "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(([r.doc_id, *brute(r.text or "")] for r in docs.collect()), key=repr)


def test_binomial_bound():
    from math import comb

    from docquarry.llm.rules import upper_tail_ok
    for n in (1, 10, 60, 200):
        for k in range(0, min(n, 12)):
            for rate in (0.01, 0.05, 0.2):
                tail = sum(comb(n, i) * rate ** i * (1 - rate) ** (n - i) for i in range(k + 1))
                assert upper_tail_ok(k, n, rate, 0.05) == (tail <= 0.05)
    assert not upper_tail_ok(0, 0, 0.5, 0.5)


def test_rules_verdict(spark, odd):
    from docquarry.llm.rules import apply_rules
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = apply_rules(docs, labels, stratum_col=None).join(labels.withColumnRenamed("doc_id", "id"), "id").filter("NOT base_failed")
    share = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] >= 0.95 and share[0] <= 0.3
    none = apply_rules(odd, spark.createDataFrame([], LABELS))
    assert none.count() == odd.count() and none.filter("kept = base_failed").count() == 0
    assert apply_rules(odd.limit(0), labels).count() == 0


def test_shards(spark, odd):
    from docquarry.llm import sharding
    rows = [r.asDict() for r in sharding.shard_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()]
    sizes = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], minlength=8)
    assert len(rows) == 1000 and np.ptp(sizes) <= 0.02 * sizes.mean()
    many = [r.asDict() for r in sharding.shard_rows(odd).collect()]
    assert len(many) == odd.count()
    assert [r["size"] for r in many if r["id"] in (1, 2)] == [1, 1]
    for some in (rows, many):
        slots = defaultdict(list)
        for r in some:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["id"], r["crc"]) for r in many} == {(r.doc_id, zlib.crc32((r.text or "").encode())) for r in odd.collect()}
    homes = defaultdict(set)
    for r in many:
        homes[r["crc"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in homes.values())
    assert sharding.shard_rows(odd.limit(0)).count() == 0


def test_shards_in_cells(spark, monkeypatch):
    from docquarry.llm import sharding
    monkeypatch.setattr(sharding, "FINE", 0.5)
    monkeypatch.setattr(sharding, "CELL", 100)
    monkeypatch.setattr(sharding, "NUMBERED", 90)
    rows = sharding.shard_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(rows) == 1000 and np.ptp(sizes) <= 0.1 * sizes.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in rows.groupby("shard")["slot"])


def test_page_text(spark):
    from docquarry.llm.html_text import extract_text, main_text
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    from html import unescape
    for r in pages:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>|<br>", " ", b) if "<br>" in b else re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert main_text(r.html) == "\n".join(b for b in blocks if b)
    page = """<html><body><header><h1>Site</h1><a href=x>Home</a></header><main><h2>Title</h2><p>One &amp; two <b>three</b>&lt;x&gt; a long paragraph,
      with more words than all the others.<p>Second &nbsp; paragraph goes on and on.<ul><li>item one<li>item two</ul></main>
      <div class="comments"><p>I disagree with all of this, and say so at length, much longer than the text itself is, on and on and on.</p></div>
      <aside>side</aside><form>Mail</form><div id="cookie-notice">We use cookies</div><script>var a = "<p>no</p>";</script><footer>end</footer></body></html>"""
    want = "Title\nOne & two three<x> a long paragraph, with more words than all the others.\nSecond paragraph goes on and on.\nitem one\nitem two"
    assert main_text(page) == want
    rows = [(1, None, None), (2, "u", ""), (None, "u", "no markup at all"), (3, "u", "<p>open <b>and <i>never closed"), (3, "u", "<p>open <b>and <i>never closed"),
            (4, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (5, "u", "<!-- only a comment"), (6, "u", "a < b and c > d"), (7, "u", "</p></div>text<")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(9)).withColumn("text", F.lit("clash"))
    got = sorted(((r.id, r.text, r.n_chars) for r in extract_text(df).collect()), key=repr)
    texts = {1: "", 2: "", None: "no markup at all", 3: "open and never closed", 4: "deep", 5: "", 6: "a < b and c > d", 7: "text<"}
    assert got == sorted(((i, texts[i], len(texts[i])) for i, _, _ in rows), key=repr)
    assert extract_text(df.limit(0)).count() == 0


def test_page_text_in_named_wrappers():
    """A class or a form does not drop the node that holds the page's text."""
    from docquarry.llm.html_text import main_text
    words = [" ".join(f"word{k * 40 + j}" for j in range(40)) + "." for k in range(4)]
    article, want = "".join(f"<p>{w}</p>" for w in words), "\n".join(words)
    menu = '<div class="nav-menu"><a href="/a">Home</a> <a href="/b">News</a></div>'
    end = '<div class="site-footer">All rights reserved here</div>'
    wrappers = ["content has-sidebar", "main-content no-sidebar", "post comment-open", "entry-content share-enabled", "wrapper footer-fixed",
                "search-enabled", "page-with-sidebar", "sidebar-layout", "post social"]
    for name in wrappers:
        for inner in (article, f"<article>{article}</article>", f"<main>{article}</main>"):
            assert main_text(f'<html><body>{menu}<div class="{name}">{inner}</div>{end}</body></html>') == want, name
        assert main_text(f'<html><body>{menu}<main><div id="{name.split()[-1]}">{article}</div></main>{end}</body></html>') == want, name
    assert main_text(f'<html><body><form action="/x" id="aspnetForm">{menu}{article}{end}</form></body></html>') == want
    assert main_text(f'<html><body>{menu}{article}<form><p>{words[0][:60]}</p></form>{end}</body></html>') == want
    # comments and teasers beside an article go, however long they are
    remarks = "".join(f'<article class="comment"><p>{w}</p></article>' for w in 4 * words)
    assert main_text(f'<html><body>{menu}<article>{article}</article><div id="comments">{remarks}</div>{end}</body></html>') == want
    teasers = f"<article><p>{words[0]}</p></article>"
    assert main_text(f'<html><body>{menu}<article>{article}</article><div class="related">{teasers}</div>{end}</body></html>') == want


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    from docquarry.llm.packing import pack_documents
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd.select(*[c.split()[0] for c in SCHEMA.split(", ")]))
    rows = pack_documents(docs, path).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array(model.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            want[r.doc_id, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()), len(ids)] += 1
    assert Counter((r.id, r.start, r.length, r.crc, r.doc_tokens) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(np.cumsum([0] + [n for _, n in b[:-1]])) and sum(n for _, n in b) <= 2048
    assert len(bins) * 2048 <= 1.03 * sum(r.length for r in rows)
    assert pack_documents(odd.limit(0), path).count() == 0
    assert pack_documents(odd.filter("doc_id < 4"), path, end_id=None).count() == 0


def test_turns_keep_all_three_limits(spark):
    from tokenizers import Tokenizer

    from docquarry.llm.packing import pack_turns
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    want = {(r.conv_id, r.turn): len(model.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in turns.collect()}
    for capacity, segments, loss in ((512, 64, 128), (2048, 4, 2048), (2048, 64, 2048), (512, 64, 256)):
        rows = pack_turns(turns, path, capacity, segments, loss).collect()
        got = Counter()
        for r in rows:
            got[r.id.conv_id, r.id.turn] += r.length
            assert r.loss_tokens == (r.length if r.id.role == "assistant" else 0)
        assert got == want  # all tokens lie in pieces
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append(r)
        tight = Counter()
        for b in bins.values():
            held = (sum(r.length for r in b), len(b), sum(r.loss_tokens for r in b))
            assert held[0] <= capacity and held[1] <= segments and held[2] <= loss
            tight.update(k for k, (x, most) in enumerate(zip(held, (capacity, segments, loss))) if x > 0.9 * most)
        if (segments, loss) == (64, 128):
            assert tight[2] > len(bins) / 3  # the limit on loss binds
        if segments == 4:
            assert tight[1] > len(bins) / 3
    odd_turns = spark.createDataFrame([(None, None, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, 1, "user", "a b " * 3000)],
                                      "conv_id long, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("id", "loss", "length", "bears")})
    rows = pack_turns(odd_turns, path, 512).collect()
    assert sum(r.loss_tokens for r in rows) == 2 and sum(r.length for r in rows) == 3 + 6001
    assert pack_turns(odd_turns.limit(0), path).count() == 0


def test_fill_keeps_all_limits():
    from docquarry.llm.packing import fill
    rng = np.random.default_rng(0)
    sizes = np.stack([rng.integers(1, 100, 700), np.ones(700), rng.integers(0, 60, 700)], axis=1).astype(float)
    bins, place = fill(sizes, (100, 5, 70))
    for b in range(bins.max() + 1):
        assert (sizes[bins == b].sum(0) <= (100, 5, 70)).all() and sorted(place[bins == b]) == list(range((bins == b).sum()))
    with pytest.raises(ValueError):
        fill(np.array([[101.0, 1, 1]]), (100, 5, 70))


def test_decontamination_sql(spark):
    from docquarry.llm.decontaminate import op10, SQL
    n, why = compare(spark, duck(SF), SF, op10, SQL)
    assert n == 200 and not why


def test_decontamination_brute(spark, odd):
    from docquarry.llm.decontaminate import decontaminate
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") for _ in range(3000)]
    items = [(1, " ".join(base[10:40])), (2, "A, b"), (3, None), (4, "..."), (5, " ".join(base[100:109])), (5, " ".join(base[10:40])), (10, " ".join(base[200:210])), (6, "x " * 30)]
    docs = [(i, " ".join(base[s:s + rng.randint(0, 90)]), None, None, None) for i, s in enumerate(rng.randrange(0, 2900) for _ in range(80))] + [(200, "x-" * 50, None, None, None)]
    df = spark.createDataFrame(docs, SCHEMA).unionByName(odd.select(*[c.split()[0] for c in SCHEMA.split(", ")]))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    windows = defaultdict(set)
    for i, t in items:
        w = re.findall(pattern, lower(t or ""))
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s:s + k])].add(i)
    want = Counter()
    for r in df.collect():
        w, hit, found = re.findall(pattern, lower(r.text or "")), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if ids := windows.get(tuple(w[s:s + k])):
                    hit.update(range(s, s + k))
                    found |= ids
        want[r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)] += 1
    got = Counter((r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(df, bench).collect())
    assert got == want
    assert decontaminate(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate(df.limit(0), bench).count() == 0


def _line_brute(docs, similarity=0.8):
    strip = " \t\r\f"
    seen = [((d is not None, d), n, line.strip(strip)) for d, t in docs for n, line in enumerate((t or "").split("\n")) if line.strip(strip)]
    lines = list(dict.fromkeys(x for _, _, x in seen))
    sets = [{x[k:k + 5] for k in range(max(1, len(x) - 4))} for x in lines]
    parent, where = list(range(len(lines))), defaultdict(list)
    for k, z in enumerate(sets):
        common = Counter(q for g in z for q in where[g])
        for q, v in common.items():
            if v >= similarity * (len(z) + len(sets[q]) - v):
                a, b = find(parent, q), find(parent, k)
                parent[max(a, b)] = min(a, b)
        for g in z:
            where[g].append(k)
    index, keep, gone = {x: k for k, x in enumerate(lines)}, {}, defaultdict(list)
    for d, n, x in seen:
        root = find(parent, index[x])
        keep[root] = min(keep.get(root, (d, n)), (d, n))
    for d, n, x in seen:
        if keep[find(parent, index[x])] != (d, n):
            gone[d[1]].append(n)
    return gone


def test_line_dedup(spark, odd):
    from docquarry.llm.line_dedup import dedup_lines
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(6)
    base = [" ".join(f"word{rng.randint(0, 999)}" for _ in range(30)) for _ in range(8)]
    copies = [(1000 + i, "\n".join(b.replace(b.split()[rng.randint(0, 29)], f"other{rng.randint(0, 99)}", 1) for b in base), "en", "a", 1) for i in range(30)]
    df = docs.unionByName(spark.createDataFrame(copies, SCHEMA))
    rows = dedup_lines(df).collect()
    gone = _line_brute([(r.doc_id, r.text) for r in df.collect()])
    differ = sum(list(r.removed) != gone.get(r.id, []) for r in rows)
    assert differ <= 3 and len(rows) == df.count()  # candidates are found by hashes; all others are exact
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in rows:
        out = set(r.removed)
        assert r.text == "\n".join(x for k, x in enumerate(texts[r.id].split("\n")) if k not in out)


def _edited_pairs(kind, n, rng):
    """Pairs of different lines of a kind, one or two letters apart, of similarity 0.8 or more."""
    letters = "abcdefghijklmnopqrstuvwxyz" if kind != "han" else "".join(map(chr, range(0x4e00, 0x5e00)))
    few, many, between = {"2-3": (2, 3, " "), "4-6": (4, 6, " "), "7-9": (7, 9, " "), "30": (30, 30, " "), "tabs": (6, 9, "\t"), "token": (12, 20, "/"),
                          "han": (8, 20, "")}[kind]
    made = []
    while len(made) < n:
        words = ("".join(rng.choices(letters, k=rng.randint(4, 11))) for _ in range(rng.randint(few, many)))
        a = b = between.join(words)
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(b))
            b = b[:k] + rng.choice(letters) + b[k + 1:]
        x, y = ({z[k:k + 5] for k in range(len(z) - 4)} for z in (a, b))
        if a != b and len(x & y) >= 0.8 * len(x | y):
            made.append((a, b))
    return made


def test_line_dedup_recall(spark):
    """Near copies are found in lines of few words and in lines without blanks."""
    from docquarry.llm.line_dedup import dedup_lines
    rng, kinds = random.Random(8), ("2-3", "4-6", "7-9", "30", "tabs", "token", "han")
    pairs = [(kind, p) for kind in kinds for p in _edited_pairs(kind, 200, rng)]
    first, other = "Internationalization specification", "Xnternationalization specification"
    pairs.append(("named", (first, other)))
    docs = [(2 * k + s, line) for k, (_, p) in enumerate(pairs) for s, line in enumerate(p)]
    removed = {r.id for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.removed}
    assert not any(k % 2 == 0 for k in removed)
    found = Counter(pairs[k // 2][0] for k in removed)
    print({kind: found[kind] / 2 for kind in kinds})
    assert all(found[kind] >= 0.96 * 200 for kind in kinds) and found["named"] == 1, found


def test_line_bound_keeps_all_alike(spark):
    """The test before the whole comparison lets every pair of the similarity pass, and few random ones."""
    from docquarry.llm.line_dedup import bitmaps, may_be_alike
    rng = random.Random(9)
    pairs = [p for kind in ("2-3", "7-9", "30", "han") for p in _edited_pairs(kind, 50, rng)] + [("ab" * 300, "ab" * 5), ("x" * 5, "x" * 900)]
    lines = spark.createDataFrame([(2 * k + s, line) for k, p in enumerate(pairs) for s, line in enumerate(p)], "o long, line string")
    alike = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(pairs))], "a long, b long")
    assert may_be_alike(bitmaps(lines), alike, 0.8).count() == len(pairs)
    apart = spark.createDataFrame([(2 * k, 2 * k + 2) for k in range(200)], "a long, b long")
    assert may_be_alike(bitmaps(lines), apart, 0.8).count() <= 2


def test_pairs_of_a_bucket_end_where_they_are_made(spark):
    """Of the pairs across the components of a bucket only those that can be alike are handed on, and all of these."""
    from docquarry.llm.line_dedup import across_pairs, bitmaps
    rng = random.Random(10)
    pairs = [p for kind in ("2-3", "7-9", "30", "han") for p in _edited_pairs(kind, 20, rng)]
    lines = spark.createDataFrame([(2 * k + s, line) for k, p in enumerate(pairs) for s, line in enumerate(p)], "o long, line string")
    left = lines.select((F.col("o") % 3 * 0).alias("bucket"), "o", F.col("o").alias("c"))
    got = {tuple(r) for r in across_pairs(left, bitmaps(lines), 0.8).collect()}
    assert {(2 * k, 2 * k + 1) for k in range(len(pairs))} <= got and len(got) <= 2 * len(pairs)
    whole = left.withColumn("c", F.floor(F.col("o") / 2))  # one component has no pairs
    assert not any(r.a // 2 == r.b // 2 for r in across_pairs(whole, bitmaps(lines), 0.8).collect())


def test_line_dedup_odd(spark, odd):
    from docquarry.llm.line_dedup import dedup_lines
    got = {(r.id, r.text, tuple(r.removed)) for r in dedup_lines(odd).collect()}
    text = odd.filter("doc_id = 4").orderBy(F.length("text")).first().text
    assert (1, None, ()) in got and (2, "", ()) in got and (3, "   \n\t\n ", ()) in got
    assert (None, text, ()) in got and (4, "", (0,)) in got and (5, "", tuple(range(40))) in got
    assert dedup_lines(odd).count() == odd.count() and dedup_lines(odd.limit(0)).count() == 0
    twice = odd.filter("doc_id = 4 AND lang = 'en'")
    assert [r.text for r in dedup_lines(twice).collect()] == [text, text]  # rows equal in id and text are one document


def test_quality(spark, odd):
    from docquarry.llm.quality import quality_scores
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").toPandas()
    held = rows[rows.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.id]).all() and len(held) > 500
    assert (held.predicted == held.quality).mean() >= 0.95
    assert held[held.quality == 1].predicted.mean() >= 0.97
    none = quality_scores(odd, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == odd.count() and {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert quality_scores(odd.limit(0), labels).count() == 0


def test_labels_held_out_are_not_learned(spark):
    from docquarry.llm.quality import held_out, quality_scores
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.id: r.score for r in quality_scores(docs, x).collect()} for x in (labels, turned))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_licenses(spark, odd):
    from docquarry.llm.licenses import scan_licenses
    said = {1: ("Text.\nThis file is licensed under the Apache License Version 2.0, see below\nmore", "apache-2.0"), 2: ("The driving license was lost by the driver", "unknown"),
            3: ("MIT License", "mit"), 4: ("Distributed under the GNU Affero General Public License version 3 only", "agpl"),
            5: ("copyright software rights things creative", "unknown"), 6: ("Copyright 2020 by us. All rights reserved.", "proprietary")}
    docs = odd.select("doc_id", "text", F.lit(1).alias("family")).union(
        spark.createDataFrame([(100 + i, t, 1) for i, (t, _) in said.items()], "doc_id long, text string, family int"))
    rows, statements = scan_licenses(docs)
    got = {r.id: (r.family, r.confirmed) for r in statements.join(rows, "row").collect()}
    assert got == {100 + i: (f, f != "unknown") for i, (_, f) in said.items()}
    assert {r.id: r.n_paragraphs for r in rows.collect()}[1] == 0 and rows.count() == docs.count()
    rows, statements = scan_licenses(docs.limit(0))
    assert rows.count() == 0 and statements.count() == 0


def test_license_scan_finds_planted_lines(spark):
    from docquarry.llm.licenses import op3
    known = {"apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0.",
             "gpl": "This work is licensed under the GNU General Public License, version 3.", "proprietary": "All rights reserved."}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: ",".join(sorted(f for f, line in known.items() if line in t.split("\n"))) for i, t in docs.items()}
    assert {r.doc_id: r.families for r in op3(spark, SF).collect()} == want


def test_licenses_without_anchor_words(spark):
    """Paragraphs without an anchor word are compared with the templates too."""
    from docquarry.llm.licenses import scan_licenses
    docs = spark.createDataFrame([(1, "is distributed on an as is basis, without conditions of any kind, either express or implied\nmore"),
                                  (2, "You may not use this file except in compliance with the\nof the world"), (3, "nothing to see here\nat the")], "doc_id long, text string")
    rows, statements = scan_licenses(docs)
    got = {(r.id, r.n): (r.family, r.confirmed) for r in statements.join(rows, "row").collect()}
    assert got == {(1, 0): ("apache-2.0", True), (2, 0): ("apache-2.0", True)}


def test_pipeline(spark):
    import corpus_pipeline
    from docquarry.session import cut
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        stages[name] = docs = cut(stage(spark, docs, SF), "test")
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in stages.items()}
    assert ids["packing"] == ids["decontamination"] <= ids["near_dedup"] <= ids["line_dedup"] == ids["quality"]
    gone = _line_brute([(r.doc_id, r.text) for r in stages["quality"].collect()])
    before, after = ({r.doc_id: r.text for r in stages[n].collect()} for n in ("quality", "line_dedup"))
    assert sum("\n".join(x for k, x in enumerate(before[i].split("\n")) if k not in set(gone.get(i, []))) != after[i] for i in after) <= 2
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == stages["packing"].columns and run.count() == stages["packing"].count()


def test_pipeline_stages_take_odd_rows(spark, odd):
    import corpus_pipeline
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() > 0
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_quality_stage_without_labels_keeps_all(spark, odd, tmp_path):
    import corpus_pipeline
    docs = odd.select(*corpus_pipeline.COLUMNS)
    for labels in ([], [(4, 1, 0)], [(1, 0, 0), (2, None, 0)]):  # one trusted text cannot both fit and judge
        spark.createDataFrame(labels, LABELS).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        assert plain(corpus_pipeline.keep_quality(spark, odd, str(tmp_path)), *docs.columns) == plain(docs, *docs.columns)


def test_pipeline_deletes_what_it_has_read(spark):
    import os

    import corpus_pipeline
    from docquarry.session import shared_dir
    before = set(os.listdir(shared_dir(spark)))
    corpus_pipeline.run(spark, SF).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared_dir(spark))) - before}
    assert left == {"stage_decontamination", "pieces"}


def test_no_python_on_native_paths(spark):
    from docquarry.llm.line_dedup import op9
    from docquarry.llm.licenses import op3
    for op in (op9, op3):
        plan = op(spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_lines_that_share_a_passage_meet_by_rare_shingles(spark):
    """No pair of the similarity is left out, and lines that have only a long passage in common hardly meet."""
    from docquarry.llm.line_dedup import SHINGLE, dedup_lines, rare_pairs
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    passage = "".join(rng.choice(letters) for _ in range(210))
    lines = [passage + "".join(rng.choice(letters) for _ in range(90)) for _ in range(300)]
    for _ in range(40):  # near copies with some letters changed anywhere
        line = list(rng.choice(lines[:300]))
        for _ in range(rng.randint(1, 6)):
            line[rng.randrange(len(line))] = rng.choice(letters)
        lines.append("".join(line))
    lines += ["x" * 300, "x" * 700, "short", "shore"]
    sets = [{s[i:i + SHINGLE] for i in range(len(s) - SHINGLE + 1)} for s in lines]
    alike = {(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {tuple(r) for r in rare_pairs(spark.createDataFrame(list(enumerate(lines)), "o long, line string"), 0.8).distinct().collect()}
    assert alike <= got and len(alike) >= 40
    assert len(got) < 2000  # of 59,000
    root = list(range(len(lines)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in alike:
        root[max(find(i), find(j))] = min(find(i), find(j))
    gone = {r.id for r in dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect() if r.removed}
    assert gone == {i for i in range(len(lines)) if find(i) != i}


def test_lines_of_few_words_meet_where_enough_is_behind(spark):
    """Lines made of the same few words share rare shingles everywhere; a pair ends where too few shingles are behind the shared one."""
    from docquarry.llm.line_dedup import SHINGLE, rare_pairs
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    lines = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(250)]
    for _ in range(40):
        parts = rng.choice(lines[:250]).split(" ")
        parts[rng.randrange(len(parts))] = rng.choice(words)
        lines.append(" ".join(parts))
    sets = [{s[i:i + SHINGLE] for i in range(len(s) - SHINGLE + 1)} for s in lines]
    alike = {(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = [tuple(r) for r in rare_pairs(spark.createDataFrame(list(enumerate(lines)), "o long, line string"), 0.8).collect()]
    assert alike <= set(got) and len(alike) >= 20
    assert len(got) < 2000, len(got)


def test_line_pairs_in_passes(spark, monkeypatch):
    """More passes over shares of the buckets give the same lines."""
    from docquarry.llm import line_dedup as L
    left = spark.createDataFrame([(b, o, o // 2, 3) for b in range(20) for o in range(6)], "bucket long, o long, c long, k int")
    assert L.passes(left) == 1 and L.passes(left.limit(0)) == 1
    rng = random.Random(22)
    lines = [" ".join(str(rng.randint(100, 999)) for _ in range(12)) for _ in range(30)]
    for i in range(90):  # chains of edited lines, so that buckets have several components
        parts = lines[i].split(" ")
        parts[rng.randrange(len(parts))] = str(rng.randint(100, 999))
        lines.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    whole = sorted(tuple(r) for r in L.dedup_lines(docs).collect())
    monkeypatch.setattr(L, "PASS", 1)
    assert L.passes(left) == 2
    seen = []
    monkeypatch.setattr(L, "passes", lambda rows: seen.append(3) or 3)
    assert sorted(tuple(r) for r in L.dedup_lines(docs).collect()) == whole and seen == [3]
