import os

from pyspark.sql import functions as F

from docquarry.operators import index as X
from docquarry.operators.retrieve import SearchConfig
from docquarry.plans.benchmark import run_benchmark
from docquarry.plans.ingest import ingest, open_corpus
from docquarry.session import fresh_path, shared_dir

WORDING = ["SBI Saral Suraksha\n1 Coverage\n1.1 Base Covers\nOn death of the insured person 100% of the sum insured is payable to the nominee.\n"
           "the loan protec-\ntion cover is an option of this plan.\n- education grant of 10%", "2 Exclusions\nSuicide within 12 months is not covered.\nPage 2"]
HOME = ["HDFC Home\n1 Coverage\nDamage to the building by fire or earthquake is paid up to Rs. 500000 per year.\nBuilding  Contents  Limit\nBrick   Goods   10%\n"]


def test_documents_to_answers(spark):
    rows = [("SBI/Personal Accident/Saral/saral_wording.txt", i, t, None) for i, t in enumerate(WORDING, 1)]
    rows += [("HDFC-home/home_brochure.txt", i, t, None) for i, t in enumerate(HOME, 1)]
    rows += [("SBI/Copy/z_copy.txt", i, t, None) for i, t in enumerate(WORDING, 1)]  # same first page
    rows += [("SBI/Scan/scan.txt", 1, " ", "Glossary of the scanned page with enough text. It means something.")]
    pages = spark.createDataFrame(rows, "relative_path string, page int, text string, alt_text string")
    out = fresh_path(spark, "corpus")
    before = set(os.listdir(shared_dir(spark)))
    ingest(pages, out, buckets=4)
    assert set(os.listdir(shared_dir(spark))) - before == {os.path.basename(out)}  # no stage is left behind
    corpus = open_corpus(spark, out)
    docs = {r["source"]: r for r in corpus.documents.collect()}
    # of two files with one first page the first path stays
    assert set(docs) == {"home_brochure.txt", "z_copy.txt", "scan.txt"}
    assert (docs["home_brochure.txt"]["carrier"], docs["home_brochure.txt"]["line_of_business"]) == ("HDFC", "home")
    catalog = corpus.catalog
    texts = [r["text"] for r in catalog.select("text").collect()]
    assert any("loan protection cover" in t for t in texts) and any("Table (Coverage): Building = Brick" in t for t in texts)
    metrics = corpus.report("metrics").first()
    assert (metrics["documents"], metrics["pages"]) == (3, 4) and metrics["chunks"] == corpus.chunks.count()

    vectors = X.encode_hashed(catalog, spark.createDataFrame([(0, "x")], "query_id long, query string"))[0]
    items = spark.createDataFrame([
        (1, "How much is paid on death of the insured person under SBI?", "Base Covers", ["death", "100%"], ["toll free"]),
        (2, "damage to the building by fire or earthquake HDFC home", "Coverage", ["fire", "earthquake"], []),
        (3, "capital of Mars", "Planets", ["Mars"], []),
    ], "query_id long, query string, expected_heading string, expected_keywords array<string>, negative_keywords array<string>")
    asked = X.encode_hashed(catalog, items)[1]
    got = run_benchmark(vectors, asked, SearchConfig(), corpus.index)
    ranks = {r["query_id"]: (r["hit"], r["rank"]) for r in got["queries"].collect()}
    assert ranks[1] == (True, 1) and ranks[2] == (True, 1) and ranks[3] == (False, -1)
    assert got["summary"].first()["hit_rate"] == 0.6667
    assert {r["query_id"]: r["failure_cluster"] for r in got["failures"].collect()}[3].startswith("Recall Failure (Empty")
    tiers = {r["query_id"] for r in got["results"].filter(F.col("confidence_tier") == "HIGH").collect()}
    assert tiers <= {1, 2}
