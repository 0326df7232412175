"""One round of work: claim what is due, check that it still holds, run the handlers, write what came of it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Registry
from ..sources import Conflict, Sources, StateStore, Version
from .handlers import OUTCOMES, run_handlers
from .planner import KEYS, fan_out
from .transitions import allowed, claim, due, finalize_tasks, throttled


def outcomes(claimed: DataFrame, sources: Callable[[str], DataFrame], registry: Registry, now: datetime, columns: dict[str, list[str]] | None = None, caller: Callable[[Callable[[], Any]], Any] = lambda run: run(), ranges: dict[str, tuple] | None = None) -> DataFrame:
    """What the tasks' handlers make of claimed records: one scan of each source, whose rows are planned anew, and one join.

    A record whose row is gone, no longer matches or has other watched values is skipped without a call. The others' rows
    come along in the column document: all columns, or by source those named. With the ranges of the records' keys by source
    (see key_ranges), only what may hold them is read; a source without a range has no records."""
    kind = claimed.schema["source_doc_id"].dataType.simpleString()
    parts = []
    for name in registry.sources():
        tasks = [d for d in registry.of_source(name) if d.handler is not None]
        if not tasks or (ranges is not None and name not in ranges):
            continue
        rows = sources(name)
        if ranges is not None:
            rows = rows.filter(F.col(tasks[0].key).between(*ranges[name]))
        mine = claimed.filter(F.col("task").isin([d.name for d in tasks]))
        fresh = fan_out(rows, tasks, now, (columns or {}).get(name) or rows.columns)
        fresh = fresh.select(*KEYS, F.col("observed").alias("__observed"), "document", F.lit(True).alias("__there"))
        valid = F.coalesce(F.col("__there") & F.col("observed").eqNullSafe(F.col("__observed")), F.lit(False)).alias("__valid")
        joined = mine.join(fresh, KEYS, "left").select(*KEYS, "attempts", "observed", "document", valid)
        parts.append(run_handlers(joined, {d.name: d.handler for d in tasks}, now, caller))
    if not parts:
        return claimed.sparkSession.createDataFrame([], OUTCOMES.format(key=kind))
    return reduce(DataFrame.unionByName, parts)


def key_ranges(keys: DataFrame, registry: Registry) -> dict[str, tuple]:
    """The least and greatest key of claimed records of each source: a small row for each task."""
    found: dict[str, tuple] = {}
    for r in keys.groupBy("task").agg(F.min("source_doc_id").alias("low"), F.max("source_doc_id").alias("high")).collect():
        low, high = found.get(name := registry.by_name[r.task].source, (r.low, r.high))
        found[name] = (min(low, r.low), max(high, r.high))
    return found


def work(state: DataFrame, sources: Callable[[str], DataFrame], registry: Registry, now: datetime, n: int, visibility_ms: int = 60_000, waiting: dict[str, datetime] | None = None, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """The state after a round over the n first due records, as one plan. Tasks without a handler, and those that wait, are
    not claimed. Handlers run when the result is computed, once for each time; Worker writes between the steps."""
    tasks = [d for d in registry.by_name.values() if d.handler is not None]
    names = allowed([d.name for d in tasks], waiting or {}, now)
    keys = due(state, now, n, names).select(*KEYS, F.lit(True).alias("__mine"))
    locked = claim(state, now, n, visibility_ms, names)
    mine = locked.join(keys, KEYS).drop("__mine")
    return finalize_tasks(locked, outcomes(mine, sources, registry, now, columns), now, tasks)


class Worker:
    """Rounds of work over a stored state. The claim is written before handlers run, and what they say before it is used, so
    a handler is called once for a claim unless an executor is lost, and a driver that dies leaves locks that run out. What
    is due comes from the state's index. Where another writer, such as the stream, has changed the same buckets meanwhile, the
    claim is made anew and outcomes are applied to the new rows, so neither's changes are lost."""

    def __init__(self, store: StateStore, sources: Sources, registry: Registry, empty: DataFrame, clock: Callable[[], datetime], n: int = 1000, visibility_ms: int = 60_000, columns: dict[str, list[str]] | None = None, caller: Callable[[Callable[[], Any]], Any] = lambda run: run(), tries: int = 10):
        self.store, self.sources, self.registry, self.empty, self.clock = store, sources, registry, empty, clock
        self.n, self.visibility_ms, self.columns, self.caller, self.tries = n, visibility_ms, columns, caller, tries
        self.waiting: dict[str, datetime] = {}

    def _claimed(self, folder: str, now: datetime, names: list[str]) -> tuple[DataFrame, Version, list[int]] | None:
        """The keys that this round has locked, the version of the lock, and their buckets; None if nothing is due."""
        for left in reversed(range(self.tries)):
            base = self.store.current()
            first = self.store.due(now, self.n, names, base)
            if first is None:
                return None
            first.select(*KEYS).write.parquet(f"{folder}/claimed-{left}")
            keys = self.empty.sparkSession.read.parquet(f"{folder}/claimed-{left}")
            touched = self.store.buckets_of(keys)
            if not touched:
                return None
            try:
                # Exactly the written keys are locked, whatever else is due by now.
                locked = claim(self.store.read(self.empty, touched, base), now, self.n, self.visibility_ms, names, keys)
                return keys, self.store.write(locked, None, touched, base), touched
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def round(self) -> int:
        """Work once; the number of records claimed."""
        spark, now = self.empty.sparkSession, self.clock()
        tasks = [d for d in self.registry.by_name.values() if d.handler is not None]
        names = allowed([d.name for d in tasks], self.waiting, now)
        folder, claimed = self.store.scratch(), 0
        if got := self._claimed(folder, now, names):
            keys, locked, touched = got
            claimed = keys.count()
            mine = self.store.read(self.empty, touched, locked).join(keys, KEYS, "left_semi")
            outcomes(mine, self.sources, self.registry, now, self.columns, self.caller, key_ranges(keys, self.registry)).write.parquet(f"{folder}/outcomes")
            said = spark.read.parquet(f"{folder}/outcomes")
            self.waiting |= throttled(said)
            self.store.update(lambda state, _: finalize_tasks(state, said, now, tasks), self.empty, only=touched)
        self.store.forget(folder)
        return claimed
