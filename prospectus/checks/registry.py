"""Registry of named queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prospectus.params import ReportParams
from prospectus.sources.staged import STAGED_PARAMS, stage_tables, with_staged
from prospectus.sources.tables import Tables

Query = Callable[[Tables, ReportParams], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(key: str, query: Query, sql: str) -> None:
    if key in _QUERIES:
        raise ValueError(f"query {key} is registered twice")
    _QUERIES[key] = query
    _SQL[key] = sql


def check(key: str, sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        register(key, query, sql)
        return query

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(stage_tables(spark, sf_dir), STAGED_PARAMS)

    return {key: bind(query) for key, query in _QUERIES.items()}


def check_sql() -> dict[str, str]:
    return {key: with_staged(sql) for key, sql in _SQL.items()}


def registered() -> dict[str, tuple[Query, str]]:
    """Query and check SQL per key, both over the source tables, for tests that bring their own."""
    return {key: (_QUERIES[key], _SQL[key]) for key in _QUERIES}
