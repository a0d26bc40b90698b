"""Registry of the named queries and of the SQL that checks them."""
from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with the SQL for the same rows where there is one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_MODULES = ("projections", "joins", "aggregations", "vectors", "filters", "windows", "text", "graphs", "scans", "stateful")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f".{name}", __package__)


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
