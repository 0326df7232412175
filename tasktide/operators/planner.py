"""Planning: which tasks a set of source rows creates, re-runs or leaves alone.

One scan serves all definitions of a source: each row carries an array of the tasks whose filter it matches, which is
then exploded. Planned rows meet the state in one full outer join on (task, source_doc_id), and every new value is a CASE
over both sides. Only value changes of what a task watches count, so replays and overlaps change nothing.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import plus_ms
from ..functions.predicates import Filters
from ..functions.projection import watched
from ..model import BUSY, TaskDefinition

KEYS = ["task", "source_doc_id"]


def fan_out(source: DataFrame, definitions: list[TaskDefinition], now: datetime, document: list[str] | None = None) -> DataFrame:
    """task, source_doc_id, observed, debounce_ms, reset_on_change for each row and matching definition; one scan. With
    document, also the row's columns of these names, as a struct.

    Definitions of one call have to watch structs of one type; give observed as JSON text with to_json where they don't."""
    filters = Filters(source.schema, now)
    structs = [watched(filters, d.watch, source.schema) for d in definitions]
    types = {source.select(s.alias("x")).schema["x"].dataType.simpleString() for s in structs}
    tasks = [
        F.when(
            filters.compile(d.filter),
            F.struct(F.lit(d.name).alias("task"), (s if len(types) == 1 else F.to_json(s)).alias("observed"), F.lit(d.debounce).cast("long").alias("debounce_ms"), F.lit(d.retry.reset_on_change).alias("reset_on_change")),
        )
        for d, s in zip(definitions, structs, strict=True)
    ]
    key = {d.key for d in definitions}
    if len(key) != 1:
        raise ValueError("definitions of one source share its key")
    matching = F.filter(F.array(*tasks), lambda t: t.isNotNull())
    # Any task's filter lets a row pass: where all are plain comparisons, their disjunction reaches the scan.
    rows = source.filter(reduce(lambda a, b: a | b, (filters.where(d.filter) for d in definitions)))
    extra = [] if document is None else [F.struct(*document).alias("document")]
    exploded = rows.select(F.col(key.pop()).alias("source_doc_id"), *extra, F.explode(matching).alias("t"))
    return exploded.select("t.task", "source_doc_id", "t.observed", "t.debounce_ms", "t.reset_on_change", *(["document"] if extra else []))


def planned(source: DataFrame, definitions: list[TaskDefinition], now: datetime) -> DataFrame:
    """The rows as records to insert: pending, due after the debounce."""
    due = plus_ms(F.lit(now).cast("timestamp_ntz"), F.col("debounce_ms"))
    at = F.lit(now).cast("timestamp_ntz")
    return fan_out(source, definitions, now).select(
        *KEYS, F.lit("pending").alias("status"), F.lit(0).alias("attempts"), due.alias("next_run_at"), due.alias("due_at"), at.alias("created_at"), at.alias("updated_at"), "observed", "reset_on_change"
    )


def actions(state: DataFrame, new: DataFrame) -> DataFrame:
    """task, source_doc_id and action: insert, changed, noop, or untouched where nothing was planned."""
    s, n = state.select(*KEYS, F.col("observed").alias("old"), F.lit(True).alias("in_state")), new.select(*KEYS, "observed", F.lit(True).alias("in_new"))
    action = F.when(F.col("in_state").isNull(), "insert").when(F.col("in_new").isNull(), "untouched").when(F.col("old").eqNullSafe(F.col("observed")), "noop").otherwise("changed")
    return s.join(n, KEYS, "full_outer").select(*KEYS, action.alias("action"))


def merge(state: DataFrame, new: DataFrame) -> DataFrame:
    """The state after planning, with state's columns. A changed row that is being worked on turns dirty and keeps its
    lock; any other changed row is pending again."""
    s = state.select(*KEYS, F.struct(*(c for c in state.columns if c not in KEYS)).alias("old"))
    n = new.select(*KEYS, F.struct(*(c for c in new.columns if c not in KEYS)).alias("new"))
    both = s.join(n, KEYS, "full_outer")
    old, fresh = F.col("old"), F.col("new")
    inserted, changed = old.isNull(), fresh.isNotNull() & old.isNotNull() & ~old["observed"].eqNullSafe(fresh["observed"])
    busy = old["status"].isin(*BUSY)
    forget = changed & fresh["reset_on_change"]
    took = lambda c, when: F.when(inserted | when, fresh[c]).otherwise(old[c])
    values: dict[str, Column] = {
        "status": F.when(inserted, fresh["status"]).when(changed & busy, "processing_dirty").when(changed, "pending").otherwise(old["status"]),
        "attempts": took("attempts", changed),
        "next_run_at": took("next_run_at", changed & ~busy),
        "due_at": took("due_at", changed),
        "updated_at": took("updated_at", changed),
        "observed": took("observed", fresh.isNotNull()),
        "first_error_at": F.when(~F.coalesce(forget, F.lit(False)), old["first_error_at"]),
        "last_error": F.when(~F.coalesce(forget, F.lit(False)), old["last_error"]),
    }
    rest = [c for c in state.columns if c not in KEYS and c not in values]
    values |= {c: F.when(inserted, fresh[c]).otherwise(old[c]) if c in new.columns else old[c] for c in rest}
    return both.select(*KEYS, *(values[c].cast(state.schema[c].dataType).alias(c) for c in state.columns if c not in KEYS)).select(state.columns)


def plan(source: DataFrame, definitions: list[TaskDefinition], state: DataFrame, now: datetime) -> DataFrame:
    """The next state. The same call serves the stream, reconciliation and tests."""
    return merge(state, planned(source, definitions, now))
