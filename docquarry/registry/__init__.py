"""Registered queries: each runs an operator on the given tables and, where SQL
can say the same, comes with the statement that checks it."""
from __future__ import annotations

import importlib

_PARTS = ("sources", "documents", "cleaning", "sections", "chunks", "index", "retrieve", "answers",
          "evaluate", "diagnostics", "apptables", "streaming")


def load() -> tuple[dict, dict]:
    from docquarry.registry.base import ORACLES, QUERIES
    for part in _PARTS:
        importlib.import_module(f"docquarry.registry.{part}")
    return QUERIES, ORACLES
