"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ["chat", "toxicity", "quality_rules", "packing", "neighbours", "langid", "quality_model", "mixing", "lm_scoring", "near_dedup", "whitening", "licenses", "spelling"]


def tables() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in MODULES:
        m = importlib.import_module(f"folioflow.llm.{name}")
        queries |= m.QUERIES
        oracle |= m.ORACLE
    return queries, oracle
