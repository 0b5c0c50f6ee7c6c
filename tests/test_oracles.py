"""Registered queries against their SQL at the smallest scale. All of them:
DOCQUARRY_ALL=1, or ``python -m tests.oracle SF_DIR``."""
import os

import pytest

from docquarry import registry
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.load()
SOME = ("s05_markdown_pages", "d02_near_dedup_first_page", "d05_folder_metadata", "c13_clean_pages", "t10_block_page_range", "k10_links_and_index",
        "r23_result_rows", "g04_reference_list", "e06_failure_clusters", "q03_corpus_report", "a09_transcript", "st2_quality_monitor")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES if os.environ.get("DOCQUARRY_ALL") else SOME)
def test_query(spark, con, name):
    n, why = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert n > 0 or name.startswith("q06")
    assert not why


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 140
