"""Search for every question of an evaluation set and score what comes back."""
from __future__ import annotations

from pyspark.sql import DataFrame

from docquarry.operators import evaluate as E
from docquarry.operators.index import KeywordIndex
from docquarry.operators.retrieve import SearchConfig, search
from docquarry.session import cut


def run_benchmark(
    chunks: DataFrame, items: DataFrame, config: SearchConfig = SearchConfig(), index: KeywordIndex | None = None,
) -> dict[str, DataFrame]:
    """``items``: query_id, query, [embedding], expected_heading,
    expected_keywords, negative_keywords. Returns results, per-query rows,
    summary, diversity, duplicates and failure categories."""
    found = search(chunks, items, config, index=index)
    results = cut(found.join(chunks.select("chunk_id", "heading_path", "carrier"), "chunk_id"), "results")
    judged = E.hit_test(results.join(items.drop("query", "embedding"), "query_id"))
    firsts = cut(E.first_hits(items, judged), "first-hits")
    pairs = E.near_duplicates(results)
    return {
        "results": results, "queries": firsts, "summary": E.retrieval_metrics(firsts), "diversity": E.diversity(items, results),
        "coverage": E.coverage_totals(results), "duplicates": E.duplicate_ratio(pairs),
        "failures": E.failure_category(items, firsts, results),
    }
