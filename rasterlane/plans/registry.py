"""Names of the queries over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

from rasterlane.plans import imagery_queries, object_queries, point_queries, scene_queries, store_queries

_ALL = object_queries.QUERIES | point_queries.QUERIES | scene_queries.QUERIES | store_queries.QUERIES | imagery_queries.QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
