"""Task definitions and the schema of task records."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.intervals import Cron, duration_ms, plus_ms
from .functions.predicates import normalize

STATUSES = ("pending", "processing", "processing_dirty", "completed", "failed")
BUSY = ("processing", "processing_dirty")
HISTORY = T.StructType().add("at", "timestamp_ntz").add("status", "string").add("duration_ms", "long").add("error", "string")


def record_schema(key: T.DataType = T.LongType(), observed: T.DataType = T.StringType()) -> T.StructType:
    """One row for each (task, source_doc_id)."""
    s = T.StructType().add("task", "string", False).add("source_doc_id", key).add("status", "string").add("attempts", "integer")
    for name in ("next_run_at", "due_at", "created_at", "updated_at", "started_at", "completed_at", "first_error_at"):
        s = s.add(name, "timestamp_ntz")
    s = s.add("last_error", "string").add("last_finalized_at", "timestamp_ntz").add("observed", observed)
    s = s.add("last_success", T.StructType().add("at", "timestamp_ntz").add("duration_ms", "long"))
    return s.add("history", T.ArrayType(HISTORY)).add("reset_on_change", "boolean")


@dataclass(frozen=True)
class RetryPolicy:
    """type: fixed, linear, exponential, series or cron. max_attempts -1 never gives up by attempts; it is 5 when neither
    bound is given."""

    type: str = "exponential"
    interval: int | str | None = None
    intervals: tuple = ()
    min: int | str | None = None
    max: int | str | None = None
    factor: float = 2
    expression: str | None = None
    tz: str = "UTC"
    max_attempts: int | None = None
    max_duration: int | str | None = None
    reset_on_change: bool = True

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        if self.type == "exponential" and self.min is None and self.max is None and self.interval is None:
            put("min", "10s")
            put("max", "1d")
        needs = {"fixed": "interval", "linear": "interval", "exponential": "min", "series": "intervals", "cron": "expression"}
        if self.type not in needs:
            raise ValueError(f"unknown retry type {self.type!r}")
        if getattr(self, needs[self.type]) in (None, ()):
            raise ValueError(f"a retry policy of type {self.type} needs {needs[self.type]}")
        for name in ("interval", "min", "max", "max_duration"):
            if getattr(self, name) is not None:
                put(name, duration_ms(getattr(self, name)))
        put("intervals", tuple(map(duration_ms, self.intervals)))
        if self.type == "exponential" and self.factor <= 0:
            raise ValueError("factor has to be above 0")
        if self.type == "cron":
            Cron(self.expression, self.tz)
        if self.max_attempts is None and self.max_duration is None:
            put("max_attempts", 5)
        if self.max_attempts is not None and (self.max_attempts < -1 or self.max_attempts == 0):
            raise ValueError("max_attempts is -1 or above 0")

    def wait_ms(self, attempts: Column) -> Column:
        """Milliseconds until the next try after that many attempts, for all types but cron."""
        n = F.greatest(attempts, F.lit(1))
        if self.type == "fixed":
            return F.lit(self.interval).cast("long")
        if self.type == "linear":
            return (n * self.interval).cast("long")
        if self.type == "series":
            return F.element_at(F.array(*map(F.lit, self.intervals)), F.least(n, F.lit(len(self.intervals))).cast("int")).cast("long")
        grown = F.lit(float(self.min)) * F.pow(F.lit(float(self.factor)), n - 1)
        return F.least(F.lit(float(self.max if self.max is not None else 2**53)), grown).cast("long")

    def next_try(self, attempts: Column, now: datetime) -> Column:
        if self.type == "cron":
            return F.lit(Cron(self.expression, self.tz).next(now)).cast("timestamp_ntz")
        return plus_ms(F.lit(now).cast("timestamp_ntz"), self.wait_ms(attempts))

    def gives_up(self, attempts: Column, first_error_at: Column, now: datetime) -> Column:
        """Attempts used up, or too long since the first error."""
        out = F.lit(False)
        if self.max_attempts is not None and self.max_attempts != -1:
            out = out | (attempts >= self.max_attempts)
        if self.max_duration is not None:
            since = F.lit(now).cast("timestamp_ntz") - F.lit(timedelta(milliseconds=self.max_duration))
            out = out | F.coalesce(first_error_at < since, F.lit(False))
        return out


DELETE_WHEN = ("source_deleted", "source_deleted_or_not_matching", "never")


@dataclass(frozen=True)
class CleanupPolicy:
    delete_when: str = "source_deleted"
    keep_for: int | str = "1d"

    def __post_init__(self) -> None:
        if self.delete_when not in DELETE_WHEN:
            raise ValueError(f"delete_when is one of {DELETE_WHEN}")
        object.__setattr__(self, "keep_for", duration_ms(self.keep_for))


ON_UPGRADE = ("none", "reprocess_failed", "reprocess_all")


@dataclass(frozen=True)
class Evolution:
    """What a new version of a handler, or a new trigger (filter and projection), sets off."""

    version: int = 1
    on_upgrade: str = "none"
    reconcile_on_trigger_change: bool = True

    def __post_init__(self) -> None:
        if not isinstance(self.version, int) or self.version < 0:
            raise ValueError("version is an integer of 0 or more")
        if self.on_upgrade not in ON_UPGRADE:
            raise ValueError(f"on_upgrade is one of {ON_UPGRADE}")


@dataclass(frozen=True)
class TaskDefinition:
    """A task: which rows of which source it is for, what of them it watches, and how it runs."""

    name: str
    source: str
    key: str
    filter: Any = None
    watch: dict[str, Any] | None = None
    debounce: int | str = 1000
    retry: RetryPolicy = field(default_factory=RetryPolicy)
    cleanup: CleanupPolicy = field(default_factory=CleanupPolicy)
    evolution: Evolution = field(default_factory=Evolution)
    history_limit: int = 5
    handler: Callable | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a task needs a name")
        object.__setattr__(self, "filter", normalize(self.filter))
        object.__setattr__(self, "debounce", duration_ms(self.debounce))
        if any(v is False or (isinstance(v, int) and v == 0) for v in (self.watch or {}).values()):
            raise ValueError("a watch projection can't exclude fields")
        if self.history_limit < 0:
            raise ValueError("history_limit is 0 or more")

    def signature(self) -> str:
        """The same text for the same trigger, whatever the order of its keys."""
        return json.dumps({"filter": self.filter, "watch": self.watch or {}}, sort_keys=True, default=str)


class Registry:
    """Definitions by unique name."""

    def __init__(self, *definitions: TaskDefinition):
        self.by_name: dict[str, TaskDefinition] = {}
        for d in definitions:
            self.add(d)

    def add(self, d: TaskDefinition) -> TaskDefinition:
        if d.name in self.by_name:
            raise ValueError(f"task {d.name} is defined already")
        self.by_name[d.name] = d
        return d

    def get(self, name: str) -> TaskDefinition:
        if name not in self.by_name:
            raise KeyError(f"unknown task {name}")
        return self.by_name[name]

    def of_source(self, source: str) -> list[TaskDefinition]:
        return [d for d in self.by_name.values() if d.source == source]

    def sources(self) -> list[str]:
        return sorted({d.source for d in self.by_name.values()})
