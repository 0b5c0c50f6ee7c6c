"""Registered queries of this subpackage, with SQL where SQL can say the same."""
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PARTS = ("token_counts", "quality", "licenses", "simhash", "rules", "sharding", "html_text", "packing", "line_dedup", "decontaminate", "language", "lexical", "whitening")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load() -> tuple[dict, dict]:
    for part in _PARTS:
        importlib.import_module(f"docquarry.llm.{part}")
    return QUERIES, ORACLES
