"""Task lists and statistics."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Filters
from ..model import STATUSES, Registry
from .planner import KEYS
from .transitions import reset, retry_by_source

SORTS = {"next_run_at": "next_run_at", "due_at": "due_at", "updated_at": "updated_at", "created_at": "created_at", "status": "status", "attempts": "attempts", "task": "task"}


@dataclass(frozen=True)
class TaskQuery:
    """All given conditions have to hold. error is a regular expression, text being case-insensitive. source_filter is a
    filter on rows of the source, or {key: value} on the key alone."""

    task: str | None = None
    status: str | list[str] | None = None
    source_doc_id: Any = None
    error: str | re.Pattern | None = None
    has_error: bool | None = None
    source_filter: dict | None = None

    def condition(self) -> Column:
        parts = [F.lit(True)]
        if self.task is not None:
            parts.append(F.col("task") == self.task)
        if self.status is not None:
            parts.append(F.col("status").isin(parse_statuses(self.status)))
        if self.source_doc_id is not None:
            parts.append(F.col("source_doc_id") == self.source_doc_id)
        if self.error is not None:
            pattern = self.error if isinstance(self.error, re.Pattern) else re.compile(self.error, re.I)
            parts.append(F.coalesce(F.col("last_error").rlike(("(?i)" if pattern.flags & re.I else "") + pattern.pattern), F.lit(False)))
        if self.has_error is not None:
            parts.append(F.col("last_error").isNotNull() if self.has_error else F.col("last_error").isNull())
        return reduce(lambda a, b: a & b, parts)


def parse_statuses(status: str | list[str]) -> list[str]:
    """A list, or text with commas; ValueError for unknown ones."""
    found = [s.strip() for s in status.split(",") if s.strip()] if isinstance(status, str) else list(status)
    if unknown := set(found) - set(STATUSES):
        raise ValueError(f"unknown status {sorted(unknown)}")
    return found


def smart_ids(text: str, key: T.DataType) -> list[Any]:
    """What a typed id may stand for in a key column: itself, lower-case hexadecimal, or its number."""
    out: list[Any] = [text] if isinstance(key, T.StringType) else []
    if isinstance(key, T.StringType) and re.fullmatch(r"[0-9a-fA-F]{24}", text):
        out.append(text.lower())
    if isinstance(key, T.NumericType) and re.fullmatch(r"\s*[+-]?\d+(\.\d+)?\s*", text):
        out.append(float(text) if "." in text else int(text))
    return sorted(set(out), key=repr)


def by_smart_id(state: DataFrame, text: str) -> DataFrame:
    ids = smart_ids(text, state.schema["source_doc_id"].dataType)
    return state.filter(F.col("source_doc_id").isin(ids) if ids else F.lit(False))


def matching(state: DataFrame, query: TaskQuery, source: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """The records of a query. A filter on anything but the key is a semi join with the filtered source."""
    found = state.filter(query.condition())
    if not query.source_filter:
        return found
    if set(query.source_filter) == {key} and not isinstance(query.source_filter[key], dict):
        return found.filter(F.col("source_doc_id") == query.source_filter[key])
    rows = source.filter(Filters(source.schema).where(query.source_filter))
    return found.join(rows.select(F.col(key).alias("source_doc_id")), "source_doc_id", "left_semi")


def page(records: DataFrame, sort: str = "next_run_at", descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in a total order: nulls last, ties by key. Spark takes limit + offset rows of each partition."""
    if sort not in SORTS:
        raise ValueError(f"can't sort by {sort}")
    c = F.col(SORTS[sort])
    return records.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *KEYS).offset(offset).limit(limit).drop("observed")


def union(states: list[DataFrame]) -> DataFrame:
    """States of several sources as one; keys as text where their types differ."""
    kinds = {s.schema["source_doc_id"].dataType.simpleString() for s in states}
    if len(kinds) > 1:
        states = [s.withColumn("source_doc_id", F.col("source_doc_id").cast("string")) for s in states]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), states)


def status_counts(records: DataFrame, by_task: bool = False) -> DataFrame:
    return records.groupBy(*(["task"] if by_task else []), "status").agg(F.count("*").alias("n"))


def error_counts(records: DataFrame, by_task: bool = False) -> DataFrame:
    return records.groupBy(*(["task"] if by_task else [])).agg(F.count("last_error").alias("errors"))


def facet(records: DataFrame) -> DataFrame:
    """All statistics from one scan: a row for each (task, status), one for each task and one for all; level says which."""
    sets = records.groupingSets([["task", "status"], ["task"], []], "task", "status")
    out = sets.agg(F.count("*").alias("n"), F.count("last_error").alias("errors"), F.min(F.when(F.col("status") == "pending", F.col("due_at"))).alias("first_due"), F.grouping_id().alias("g"))
    return out.select(F.when(F.col("g") == 0, "task_status").when(F.col("g") == 1, "task").otherwise("all").alias("level"), "task", "status", "n", "errors", "first_due")


def per_task(records: DataFrame) -> DataFrame:
    """A column for each status, and the errors and first due time of pending records."""
    return records.groupBy("task").agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count("last_error").alias("errors"), F.min(F.when(F.col("status") == "pending", F.col("due_at"))).alias("first_due")
    )


def info(records: DataFrame, registry: Registry) -> DataFrame:
    """Counts for each defined task, also those without records: success, failed, processing (dirty or not), pending,
    error; ordered by name."""
    spark = records.sparkSession
    names = spark.createDataFrame([(d.name, d.source) for d in registry.by_name.values()], "task string, source string")
    s = F.col("status")
    counts = records.groupBy("task").agg(
        F.count_if(s == "completed").alias("success"), F.count_if(s == "failed").alias("failed"), F.count_if(s.isin("processing", "processing_dirty")).alias("processing"), F.count_if(s == "pending").alias("pending"), F.count("last_error").alias("error")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("success", "failed", "processing", "pending", "error")}
    return names.join(counts, "task", "left").withColumns(zero).orderBy("task")


def tasks_by_source(registry: Registry) -> dict[str, list[str]]:
    return {s: sorted(d.name for d in registry.of_source(s)) for s in registry.sources()}


def overview(state: DataFrame, query: TaskQuery, source: DataFrame | None = None, key: str | None = None, **paging: Any) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A page, the number of all matching records, and status counts that leave the query's status and error aside."""
    found = matching(state, query, source, key)
    around = matching(state, replace(query, status=None, error=None, has_error=None), source, key)
    return page(found, **paging), found.agg(F.count("*").alias("total")), status_counts(around)


def retry(state: DataFrame, registry: Registry, query: TaskQuery, now: datetime, sources: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """The state with a query's records reset; all tasks if it names none. An unknown name is an error."""
    tasks = [registry.get(query.task)] if query.task is not None else list(registry.by_name.values())
    mine = F.col("task").isin([d.name for d in tasks])
    if not query.source_filter:
        return reset(state, mine & query.condition(), now)
    for name in sorted({d.source for d in tasks}):
        here = [d for d in tasks if d.source == name]
        rows = sources(name)
        keys = rows.filter(Filters(rows.schema, now).where(query.source_filter)).select(F.col(here[0].key).alias("source_doc_id"))
        state = retry_by_source(state, keys, F.col("task").isin([d.name for d in here]) & query.condition(), now)
    return state
