"""All queries of the package and the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ["text_queries", "linkage_queries", "resolution_queries", "review_queries", "revision_queries", "integrity_queries", "log_queries"]


def tables() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in MODULES:
        m = importlib.import_module(f"folioflow.plans.{name}")
        queries |= m.QUERIES
        oracle |= m.ORACLE
    return queries, oracle
