"""Registered queries and their SQL twins for the result check."""

from __future__ import annotations

from catalog import (
    base_tables,
    calendar_queries,
    distinct_queries,
    impact_queries,
    index_queries,
    quality_queries,
    roster_queries,
    wage_queries,
    weekly_queries,
)

MODULES = (
    index_queries,
    weekly_queries,
    wage_queries,
    roster_queries,
    impact_queries,
    base_tables,
    calendar_queries,
    quality_queries,
    distinct_queries,
)


def all_queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
