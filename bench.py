"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docquarry import registry  # noqa: E402
from docquarry.session import local_session  # noqa: E402

HEADLINES = (
    "c13_clean_pages", "d02_near_dedup_first_page", "d03_chunk_dedup", "t09_block_segmentation", "m04_enriched_chunks",
    "k10_links_and_index", "x02_term_stats", "x04_bm25_scoped_scores", "x06_vector_knn", "r23_result_rows",
    "e02_retrieval_metrics", "e05_jaccard_duplicates", "e15_weight_grid", "q03_corpus_report", "a05_latest_feedback",
    "st2_quality_monitor",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = registry.load()
    spark.read.parquet(f"{folder}/documents.parquet").count()  # start-up is not measured
    times = {}
    for name in only:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf.group(1)) if sf else folder}))
    spark.stop()


if __name__ == "__main__":
    main()
