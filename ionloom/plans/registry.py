"""All core queries and their SQL twins."""

from __future__ import annotations

from ionloom.plans import annotation_queries, core_queries, ms1_queries, ms2_queries, spatial_queries, table_queries

MODULES = [ms2_queries, ms1_queries, spatial_queries, annotation_queries, table_queries, core_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
