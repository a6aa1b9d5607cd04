"""Derived views and the catalogue of queries."""

from __future__ import annotations

from memloom.plans.catalogue import ORACLE, QUERIES, Query


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries by name, and the SQL of those that SQL can express."""
    from memloom.plans import store_queries, text_queries  # noqa: F401  they register themselves

    return QUERIES, ORACLE
