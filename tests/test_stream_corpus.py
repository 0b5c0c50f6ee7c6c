import pytest
from pyspark.errors import StreamingQueryException

from docquarry.operators.retrieve import search
from docquarry.plans import ingest as P
from docquarry.plans.ingest import ingest, open_corpus, refresh
from docquarry.session import fresh_path
from docquarry.streaming import corpus as C
from tests.test_incremental import files, pages_of, stored


def test_stream_builds_the_corpus_that_search_reads(spark, monkeypatch):
    arriving, out, check, whole = (fresh_path(spark, n) for n in ("arriving", "corpus", "check", "corpus"))
    given = files(6)
    names = sorted(given)

    def arrive(*paths, extra=()):
        pages = pages_of(spark, {p: given[p] for p in paths})
        pages.union(spark.createDataFrame(list(extra), pages.schema)).coalesce(1).write.mode("append").parquet(arriving)

    def run():
        stream = spark.readStream.schema(C.PAGES).option("maxFilesPerTrigger", 1).parquet(arriving)
        C.start_corpus(stream, out, check, buckets=4).awaitTermination()

    def states():
        return {r["relative_path"]: (r["status"], r["error_message"]) for r in C.file_status(spark, out).collect()}

    C.announce(pages_of(spark, given), out)
    assert set(states().values()) == {("pending", None)}
    arrive(*names[:3], extra=[(None, 1, "x" * 2000, None)])
    run()
    got = states()
    assert [got[n] for n in names] == [("completed", None)] * 3 + [("pending", None)] * 3
    assert got[None][0] == "failed" and len(got[None][1]) == 1000

    # the batch dies; its files are failed and the corpus is as before; a new start runs it again
    arrive(*names[3:])
    with monkeypatch.context() as patch:
        def die(*args, **kwargs):
            raise RuntimeError("disk is lost")
        patch.setattr(P, "build_chunks", die)
        with pytest.raises(StreamingQueryException):
            run()
    assert {states()[n][0] for n in names[3:]} == {"failed"} and "disk is lost" in states()[names[4]][1]
    assert open_corpus(spark, out).version.number == 1
    run()
    assert {states()[n] for n in names} == {("completed", None)}

    # what arrives again unchanged writes nothing
    arrive(names[0], names[5])
    run()
    assert open_corpus(spark, out).version.number == 2
    refresh(spark, out)
    ingest(pages_of(spark, given), whole, buckets=4)
    corpus = open_corpus(spark, out)
    assert stored(corpus) == stored(open_corpus(spark, whole))
    assert {"chunk_id", "page_start", "parent_chunk_id", "carrier", "line_of_business", "heading_path"} <= set(corpus.catalog.columns)

    from docquarry.operators.index import encode_hashed
    asked = spark.createDataFrame([(1, "fire number 4 is paid up to 400")], "query_id long, query string")
    vectors, queries = encode_hashed(corpus.catalog, asked)
    best = search(vectors, queries, index=corpus.index).filter("rank = 1").join(corpus.catalog.select("chunk_id", "relative_path"), "chunk_id").first()
    assert best["relative_path"] == "SBI/Home/file4.txt"
