"""Sources by name, and the stored state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .state import Conflict, StateStore, Version

__all__ = ["Conflict", "Sources", "StateStore", "Version"]


class Sources:
    """Named tables: each a function of the session, so tests can put in their own. Filters and column selections on the
    result reach the scan."""

    def __init__(self, spark: SparkSession, tables: dict[str, Callable[[SparkSession], DataFrame]] | None = None):
        self.spark, self.tables = spark, dict(tables or {})

    @classmethod
    def of_parquet(cls, spark: SparkSession, folder: str, names: list[str]) -> Sources:
        return cls(spark, {n: (lambda s, n=n: s.read.parquet(f"{folder}/{n}.parquet")) for n in names})

    def __call__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"unknown source {name}")
        return self.tables[name](self.spark)
