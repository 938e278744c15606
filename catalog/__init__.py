"""The query catalogue: each operator run on the given tables, next to its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.tables import with_views

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_GROUPS = (
    "profiles", "rows", "columns", "cleaning", "analytics", "validation", "audit",
    "joins", "time_joins", "insights", "series", "sql_text", "vectors", "intents", "sources", "near_copies", "models",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows can be checked."""

    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = with_views(sql)
        return fn

    return register


def _load() -> None:
    for group in _GROUPS:
        importlib.import_module(f"catalog.{group}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
