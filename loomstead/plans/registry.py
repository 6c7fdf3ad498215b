"""All queries of the core package with their SQL."""

from __future__ import annotations

from loomstead.plans import packed_queries, reference_queries, survey_queries

MODULES = [packed_queries, reference_queries, survey_queries]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
