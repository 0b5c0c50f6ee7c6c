import pytest
from pyspark.sql import functions as F

from docquarry.operators import chunks as K
from docquarry.operators import documents as D
from docquarry.operators import evaluate as E


def test_table_rows(spark):
    tables = [(["| a | b |", "| --- | --- |", "| 1 | 2 |", "|  |  |", "| 3 |"],), (["| a | b |", "| 1 | 2 |"],), (["| only |"],)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, l array<string>")
    got = [tuple(r) for r in df.select("i", F.inline(K.table_row_texts(F.col("l"), F.lit("T")))).orderBy("i", "row").collect()]
    assert got == [(0, 1, "Table (T): a = 1; b = 2."), (0, 3, "Table (T): a = 3."), (1, 1, "Table (T): a = 1; b = 2.")]


KINDS = [
    ("| x |", "table", "", "table"), ("what is this?", "paragraph", "", "faq"), ("it is not covered", "paragraph", "", "exclusion"),
    ("the waiting period", "paragraph", "", "waiting_period"), ("cashless", "paragraph", "", "claim_process"), ("text", "paragraph", "Claims", "claim_process"),
    ("pay the premium", "paragraph", "", "premium"), ("entry age 18", "paragraph", "", "eligibility"), ("a network hospital", "paragraph", "", "hospital_network"),
    ("text", "paragraph", "Definitions", "definition"), ("Hospital means a place", "paragraph", "", "definition"), ("sum insured", "paragraph", "", "benefit"),
    ("we discover", "paragraph", "", "coverage"), ("helpline", "paragraph", "", "contact"), ("plain", "paragraph", "", "general"),
    ("premium is not covered", "paragraph", "", "exclusion"), ("benefit of coverage", "paragraph", "", "benefit"),
]


def test_semantic_types(spark):
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(KINDS)], "i int, text string, chunk_type string, heading_path string, want string")
    assert [(r["text"], r["semantic_type"]) for r in K.enrich(df).orderBy("i").collect()] == [(k[0], k[3]) for k in KINDS]


def test_flags_and_references(spark):
    df = spark.createDataFrame([(0, "see Section 4.2(a), section 4.2(A) and Clause IV"), (1, "12 % for 30 days, Rs. 500"), (2, "years 5")], "i int, text string").withColumns(
        {"chunk_type": F.lit("paragraph"), "heading_path": F.lit("")})
    got = K.enrich(df).orderBy("i").collect()
    assert got[0]["references"] == "Section 4.2(a)|Clause IV"
    assert (got[1]["contains_percentage"], got[1]["contains_duration"], got[1]["contains_money"]) == (True, True, True)
    assert got[2]["contains_money"]  # no word boundary in the pattern


def test_context_prefix(spark):
    df = spark.createDataFrame([("t", "A > B", "SBI", "health", ""), ("t", "", "", "", "")], "t string, p string, c string, l string, e string")
    label = K.product_label(F.col("l"), F.col("e"), F.col("e"), F.col("e"))
    got = [r[0] for r in df.select(K.with_context(F.col("t"), F.col("p"), F.col("c"), label)).collect()]
    assert got == ["[Context: Carrier: SBI | Product: health | Heading: A > B] \n\nt", "t"]


def test_short_pack_merges(spark):
    packs = [(0, 0, "a" * 900), (0, 1, "b" * 50), (0, 2, "c" * 990), (1, 0, "d" * 20), (2, 0, "e" * 1390), (2, 1, "f" * 30)]
    df = spark.createDataFrame([("d", 0, r, 0, p, t, p, p + 1, p + 1) for r, p, t in packs],
                               "document_id string, section_seq int, run_no int, seg int, pack long, text string, block_no int, page_start int, page_end int")
    got = [(r["run_no"], r["idx"], len(r["text"]), r["page_end"]) for r in K.merge_short_packs(df).orderBy("run_no", "idx").collect()]
    assert got == [(0, 0, 951, 2), (0, 1, 990, 3), (1, 0, 20, 1), (2, 0, 1390, 1), (2, 1, 30, 2)]
    with pytest.raises(ValueError):
        K.merge_short_packs(df, max_chars=200, min_chars=120)


def test_classifier(spark):
    df = spark.createDataFrame([("a/factsheet.pdf",), ("a/Policy-Wording.pdf",), ("a/x.pdf",)], "p string")
    assert [r[0]["document_type"] for r in df.select(D.classify(F.col("p"))).collect()] == ["primary_agreement", "primary_agreement", "general_document"]
    assert [r[0]["document_type"] for r in df.select(D.classify(F.col("p"), word_boundary=True)).collect()] == ["summary_document", "primary_agreement", "general_document"]


def test_first_page_duplicates(spark):
    df = spark.createDataFrame([("a", " Same\ntext", "1"), ("b", "same TEXT", "2"), ("c", "", "3"), ("d", " ", "4"), ("e", None, "5"), ("f", None, "5")], "relative_path string, first_page string, content string")
    left = lambda **k: sorted(r["relative_path"] for r in D.distinct_first_pages(df, **k).collect())
    assert left() == ["a", "c", "e"] and left(keep_blank=True) == ["a", "c", "d", "e"]


def test_hits(spark):
    item = ("Coverage", ["death", "100%", "sum"], ["address"])
    cases = [("x", "coverage > base", True), ("Death 100%", "other", True), ("death", "other", False), ("death 100% address", "coverage", False), ("x", "", False)]
    df = spark.createDataFrame([(i, t, h, *item) for i, (t, h, _) in enumerate(cases)],
                               "i int, text string, heading_path string, expected_heading string, expected_keywords array<string>, negative_keywords array<string>")
    assert [r["hit"] for r in E.hit_test(df).orderBy("i").collect()] == [c[2] for c in cases]
    assert E.hit_test(df, compat=True).filter("i = 4").first()["hit"]  # a blank heading is in any other


def test_citations(spark):
    a = spark.createDataFrame([(1, "SBI says page 3. " + "x" * 120 + " page 4"), (2, "none")], "query_id long, answer string")
    r = spark.createDataFrame([(1, "SBI_wording.pdf", "SBI", 3), (1, "other", "X", 9)], "query_id long, filename string, carrier string, page_number int")
    assert [tuple(x) for x in E.citations(a).orderBy("citation_no").collect()] == [(1, 0, 3, "sbi"), (1, 1, 4, "unknown")]
    assert [tuple(x) for x in E.citation_correctness(a, r).orderBy("query_id").collect()] == [(1, 2, 0.5), (2, 0, 1.0)]


def test_grid_has_all_weights():
    grid = E.weight_grid()
    assert grid.shape == (1771, 4) and abs(grid.sum(axis=1) - 1).max() < 1e-9


def test_index_writes_only_what_it_reads(spark, monkeypatch):
    """The numbering of chunks needs their ids and places; texts and enrichment are not written for it."""
    from docquarry.operators import chunks as K
    from docquarry.registry.chunks import k10
    seen, plain = [], K.index_chunks
    monkeypatch.setattr(K, "index_chunks", lambda chunks, *a, **k: (seen.extend(chunks.columns), plain(chunks, *a, **k))[1])
    assert k10(spark, "/root/testdata/sf0.001").count() > 0
    assert seen and not {"text", "page_content", "references", "semantic_type"} & set(seen)


def test_enrichment_by_plain_search(spark):
    """Keywords are found without patterns, and references only where they can begin: the same values as by the patterns alone."""
    from docquarry import fixed as V
    from docquarry.functions.text import contains_any, holds_any, rx
    from docquarry.operators.chunks import references, semantic_type
    texts = ["see Section 4.2(a), CLAUSE IV and \u017fection 4.2(a) or Sched. XI", "xSection 4", "annexure\u00a0B1 cl. 7 Sec.9 sec. 9", "Kclause 3", "", None,
             "how do i claim?", "not covered; pre-existing", "customer.care @ help"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = F.transform(F.regexp_extract_all("t", F.lit(rx(V.REFERENCE, True)), F.lit(1)), lambda x: F.lower(F.regexp_replace(x, rx(r"\s+"), " ")))
    for r in df.select("t", F.lower(references(F.col("t"))).alias("got"), F.array_join(F.array_distinct(found), "|").alias("want")).collect():
        assert r.got == r.want, r
    for words in V.SEMANTIC_KEYWORDS.values():
        assert all(a == b for a, b in df.select(holds_any(F.col("t"), words), contains_any(F.col("t"), words)).collect())
    kind = str(semantic_type(F.col("t"), F.lit("paragraph"), F.col("t"), F.col("t")))
    assert kind.lower().count("rlike") <= 2
