"""All queries of the engine by name, with equivalent SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered already")
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def query(sql: str | None = None) -> Callable:
    """Register a function under its own name."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        add(f.__name__, f, sql)
        return f

    return register


from . import filters, tasks  # noqa: E402,F401  they register their queries
