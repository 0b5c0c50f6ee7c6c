import os

import pytest

from docquarry.plans import ingest as P
from docquarry.plans.ingest import IngestConfig, ingest, open_corpus, refresh
from docquarry.session import fresh_path
from docquarry.sources import versions as W

SCHEMA = "relative_path string, page int, text string, alt_text string"


def pages_of(spark, files):
    rows = [(path, i, text, None) for path, texts in files.items() for i, text in enumerate(texts, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def files(n=8):
    return {f"SBI/Home/file{i}.txt": [f"{i + 1} Coverage\nfire number {i} is paid up to {i}00 per year.\n- item {i}\n",
                                      f"second page of file {i} says more on claims."] for i in range(n)}


def listing(out):
    return {os.path.join(at, name) for at, _, names in os.walk(out) for name in names}


def stored(corpus):
    """All rows, without what a version alone decides."""
    tables = [corpus.documents, corpus.pages, corpus.chunks, corpus.catalog, corpus.index.postings.drop("bucket"), corpus.index.weights.drop("bucket")]
    return [sorted(map(repr, t.select(sorted(t.columns)).collect())) for t in tables]


def test_second_run_on_equal_input_writes_nothing(spark):
    out = fresh_path(spark, "corpus")
    assert ingest(pages_of(spark, files()), out, buckets=4) == 1
    before = listing(out)
    # other order of rows, other partitions
    again = pages_of(spark, dict(reversed(files().items()))).repartition(5)
    assert ingest(again, out) == 1 and listing(out) == before


def test_a_change_rewrites_only_its_buckets_and_equals_a_new_corpus(spark):
    out, new = fresh_path(spark, "corpus"), fresh_path(spark, "corpus")
    given = files()
    ingest(pages_of(spark, given), out, buckets=16)
    old = open_corpus(spark, out)
    seen = stored(old)
    given["SBI/Home/file3.txt"][1] = "another second page."
    del given["SBI/Home/file5.txt"]
    given["HDFC/Motor/new.txt"] = ["1 Benefits\nthe new file pays for theft.\n"]
    assert ingest(pages_of(spark, given), out) == 2
    ingest(pages_of(spark, given), new, buckets=16)
    now = open_corpus(spark, out)
    assert stored(now) == stored(open_corpus(spark, new))
    ids = spark.createDataFrame([("SBI/Home/file3.txt",), ("SBI/Home/file5.txt",), ("HDFC/Motor/new.txt",)], "p string")
    hit = W.touched_buckets(ids.select(P.D.document_id(ids["p"]).alias("document_id")), "document_id", now.version)
    for table in ("documents", "pages", "chunks"):
        rewritten = {b for b, v in now.version.where[table].items() if v == 2}
        assert rewritten <= set(hit)
        assert set(now.version.where[table]) - set(hit) == set(old.version.where[table]) - set(hit)
    # who opened the old version still reads it
    assert stored(old) == seen


def test_changed_settings_build_all_again(spark):
    out = fresh_path(spark, "corpus")
    given = pages_of(spark, files(3))
    ingest(given, out, buckets=4, derive=False)
    assert ingest(given, out, IngestConfig(pages_per_segment=7), derive=False) == 1
    assert ingest(given, out, IngestConfig(max_chars=300), derive=False) == 2
    assert set(open_corpus(spark, out).version.where["chunks"].values()) == {2}


def test_a_run_that_dies_leaves_the_old_version(spark, monkeypatch):
    out = fresh_path(spark, "corpus")
    given = files(4)
    ingest(pages_of(spark, given), out, buckets=4)
    seen = stored(open_corpus(spark, out))
    given["SBI/Home/file9.txt"] = ["1 Scope\nflood is covered too.\n"]
    for name in ("_derive", "build_chunks"):
        with monkeypatch.context() as patch:
            def die(*args, **kwargs):
                raise RuntimeError("lost")
            patch.setattr(P, name, die)
            with pytest.raises(RuntimeError, match="lost"):
                ingest(pages_of(spark, given), out)
        assert stored(open_corpus(spark, out)) == seen
    assert ingest(pages_of(spark, given), out) == 2
    assert open_corpus(spark, out).documents.count() == 5


def test_partial_runs_refresh_and_vacuum(spark):
    out, new = fresh_path(spark, "corpus"), fresh_path(spark, "corpus")
    given = files(6)
    first = dict(list(given.items())[:3])
    ingest(pages_of(spark, first), out, buckets=4, derive=False)
    with pytest.raises(ValueError, match="refresh"):
        open_corpus(spark, out).catalog
    rest = dict(list(given.items())[3:])
    # a copy of a stored first page loses to the path before it, and wins over the one behind it
    rest["SBI/Home/z.txt"] = [given["SBI/Home/file0.txt"][0]]
    rest["SBI/A/a.txt"] = [given["SBI/Home/file1.txt"][0], "with a page of its own"]
    assert ingest(pages_of(spark, rest), out, partial=True, derive=False) == 2
    assert ingest(pages_of(spark, rest), out, partial=True, derive=False) == 2  # again: nothing to do
    assert refresh(spark, out) == 3 and refresh(spark, out) == 3
    ingest(pages_of(spark, {**given, **rest}), new, buckets=4)
    assert stored(open_corpus(spark, out)) == stored(open_corpus(spark, new))
    before = stored(open_corpus(spark, out))
    W.vacuum(spark, out, keep=1)
    assert stored(open_corpus(spark, out)) == before
    assert os.listdir(f"{out}/manifest") == ["0000000003"]


def test_no_pages_and_null_paths(spark):
    out = fresh_path(spark, "corpus")
    empty = spark.createDataFrame([], SCHEMA)
    assert ingest(empty, out, buckets=2) == 1
    corpus = open_corpus(spark, out)
    assert corpus.documents.count() == corpus.chunks.count() == corpus.catalog.count() == corpus.index.postings.count() == 0
    odd = spark.createDataFrame([(None, 1, "no file", None), ("x.txt", 1, None, None), ("x.txt", None, "text of no page", None), ("y.txt", 1, "", "")], SCHEMA)
    ingest(odd, out, derive=False)
    assert {r["relative_path"] for r in open_corpus(spark, out).documents.collect()} <= {"x.txt", "y.txt"}
    assert ingest(empty, out, derive=False) == 3 and open_corpus(spark, out).documents.count() == 0
