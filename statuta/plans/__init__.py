"""Named queries over the driver's tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("nested_queries", "search_queries", "document_queries", "text_queries", "page_queries", "indexing_queries")


def collect() -> tuple[dict, dict]:
    """All queries and all oracle SQL texts of the core."""
    queries, oracles = {}, {}
    for name in _MODULES:
        module = import_module(f"statuta.plans.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
