"""Query registry: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: list a query under ``name`` with its oracle, if it has one."""

    def put(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return put


def queries() -> dict[str, Query]:
    from tideline.plans import conversations, display, machines, more, pieces, reports, series, streams, texts  # noqa: F401  they register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def oracle_of(name: str) -> str | None:
    """The SQL that another query is listed with."""
    return _SQL.get(name)
