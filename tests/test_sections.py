import os
import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import chunks as K
from docquarry.operators import sections as T
from docquarry.registry.base import documents_meta, pages
from docquarry.registry.chunks import k10
from docquarry.session import shared_dir

SF = "/root/testdata/sf0.001"


def parse(spark, text_pages, **kw):
    df = spark.createDataFrame([(d, p, t) for d, ps in text_pages.items() for p, t in enumerate(ps, 1)], "document_id string, page int, text string")
    return T.parse_pages(df, **kw)


def sections(spark, *text_pages):
    atoms, seg = parse(spark, {"d": list(text_pages)})
    return [tuple(r) for r in T.section_rows(atoms, seg).orderBy("section_seq").select(
        "level", "section_number", "title", F.array_join("heading_path", ">"), "page_start", "page_end").collect()]


def blocks(spark, *text_pages):
    atoms, _ = parse(spark, {"d": list(text_pages)})
    return [tuple(r) for r in T.block_rows(atoms).orderBy("block_no").select("block_type", F.array_join("lines", "/"), "page_start", "page_end").collect()]


def test_levels_and_paths(spark):
    got = sections(spark, "1 Alpha\n1.1.1 Beta\n1.2 Gamma\n1.1.1.1.1 Delta\nALL CAPS")
    assert [g[0] for g in got] == [1, 2, 2, 3, 1]
    assert [g[3] for g in got] == ["Alpha", "Alpha>Beta", "Alpha>Gamma", "Alpha>Gamma>Delta", "ALL CAPS"]


def test_pending_ids(spark):
    assert sections(spark, "3.2\nScope of Cover")[0][:3] == (1, "3.2", "Scope of Cover")
    assert blocks(spark, "3.2\nthis is plain prose that goes on.") == [("paragraph", "3.2 this is plain prose that goes on.", 1, 1)]
    assert sections(spark, "3.2\n4.1\nScope of Cover")[0][1] == "4.1"
    assert sections(spark, "3.2\n| a | b |\nScope of Cover")[-1][:3] == (1, "3.2", "Scope of Cover")


def test_block_pages(spark):
    assert blocks(spark, "an open sentence goes", "on here and ends.") == [("paragraph", "an open sentence goes on here and ends.", 1, 2)]
    assert blocks(spark, "an open sentence goes", "- bullet", "") == [("paragraph", "an open sentence goes", 1, 2), ("bullet_group", "- bullet", 2, 3)]
    assert blocks(spark, "- one\n- two\nthen some plain prose.\nand more of it.") == [
        ("bullet_group", "- one/- two", 1, 1), ("paragraph", "then some plain prose.", 1, 1), ("paragraph", "and more of it.", 1, 1)]


@pytest.mark.parametrize("per_segment", [2])
def test_segments_change_nothing(spark, per_segment):
    """A long document, cut into segments, gives what it gives in one piece."""
    text = pages(spark, SF)
    whole, off = T.parse_pages(text)
    parts, on = T.parse_pages(text, per_segment)
    assert (off, on) == (False, True)
    cols = [c for c in whole.columns if c != "seg"]
    assert whole.select(cols).exceptAll(parts.select(cols)).isEmpty() and parts.select(cols).exceptAll(whole.select(cols)).isEmpty()
    meta = documents_meta(spark, SF)
    a = K.build_chunks(whole, meta).drop("seg")
    b = K.build_chunks(parts, meta, segmented=True).drop("seg").select(a.columns)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_shares_change_nothing(spark, monkeypatch):
    """Chunks made of a few documents at a time are those of all, and of a share only the picked columns stay on disk."""
    cols = ["document_id", "chunk_id", "local_index", "previous_chunk_id", "next_chunk_id", "text", "page_start", "page_end", "heading_path", "semantic_type"]
    whole = K.build_chunks(T.parse_pages(pages(spark, SF))[0], documents_meta(spark, SF)).select(cols)
    before = set(os.listdir(shared_dir(spark)))
    parts = K.chunk_shares(pages(spark, SF), documents_meta(spark, SF), 3, lambda c: c.select(cols))
    left = set(os.listdir(shared_dir(spark))) - before
    assert len(left) == 3 and all(name.startswith("chunks-") for name in left)
    assert whole.count() == parts.count() and whole.exceptAll(parts).isEmpty()
    monkeypatch.setattr(K, "SHARE", 1 << 20)
    texts = spark.range(5).select(F.repeat(F.lit("x"), 1 << 19).alias("text"))
    assert (K.shares(texts), K.shares(texts.limit(0))) == (3, 1)


def test_chunk_queries_leave_no_stages(spark):
    before = set(os.listdir(shared_dir(spark)))
    k10(spark, SF)
    left = {name.split("-")[0] for name in set(os.listdir(shared_dir(spark))) - before}
    assert left == {"chunks", "offsets"}


def test_random_lines_in_segments(spark):
    rng = random.Random(3)
    pool = ["1 Alpha", "2.1 Beta", "3.2", "GENERAL TERMS", "- bullet", "| a | b |", "plain prose goes on", "plain prose ends.", "A-12", "Scope of Cover"]
    docs = {f"d{i}": ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 7))] for i in range(300)}
    whole, _ = parse(spark, docs)
    parts, _ = parse(spark, docs, per_segment=1)
    cols = [c for c in whole.columns if c != "seg"]
    assert whole.count() > 1000 and whole.select(cols).exceptAll(parts.select(cols)).isEmpty()
    a, b = T.section_rows(whole), T.section_rows(parts, True)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def stack_loop(requested):
    stack, out = 1, []
    for r in requested:
        level = min(r, stack)
        stack = level + 1
        out.append(level)
    return out


def test_levels_against_a_stack(spark):
    rng = random.Random(4)
    docs = {f"d{i}": [rng.randint(1, 5) for _ in range(rng.randint(1, 12))] for i in range(400)}
    text = {d: ["\n".join(".".join(["1"] * n) + " Alpha" for n in v)] for d, v in docs.items()}
    atoms, _ = parse(spark, text)
    got = {}
    for r in atoms.filter("kind = 'heading'").orderBy("document_id", "section_seq").collect():
        got.setdefault(r["document_id"], []).append(r["level"])
    assert got == {d: stack_loop(v) for d, v in docs.items()}
