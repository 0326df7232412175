"""The life of a task record: claim, finalize, defer, reset. All work on sets of rows and take the time as `now`.

Spark has no atomic find-and-modify of one row, so one driver claims; the visibility timeout puts back what was lost.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import plus_ms
from ..model import BUSY, HISTORY, RetryPolicy, TaskDefinition
from .planner import KEYS


def _at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def is_due(now: datetime) -> Column:
    """Due by next_run_at alone, whatever the status: so a claim that ran out is due again."""
    return F.coalesce(F.col("next_run_at") <= _at(now), F.lit(False))


def due(state: DataFrame, now: datetime, n: int, tasks: list[str] | None = None) -> DataFrame:
    """The n records that are due first; a top-k, no full sort. Time and tasks are plain comparisons that reach the scan."""
    found = state.filter(F.col("next_run_at") <= _at(now))
    found = found if tasks is None else found.filter(F.col("task").isin(tasks))
    return found.orderBy("next_run_at", *KEYS).limit(n)


def claim(state: DataFrame, now: datetime, n: int, visibility_ms: int = 60_000, tasks: list[str] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The state with the n first due records, or those of the given keys, processing, locked until the visibility timeout."""
    chosen = due(state, now, n, tasks) if keys is None else keys
    marked = state.join(chosen.select(*KEYS, F.lit(True).alias("__claimed")), KEYS, "left")
    c = F.coalesce("__claimed", F.lit(False))
    return marked.withColumns(
        {
            "status": F.when(c, "processing").otherwise(F.col("status")),
            "attempts": F.when(c, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts")),
            "started_at": F.when(c, _at(now)).otherwise(F.col("started_at")),
            "next_run_at": F.when(c, plus_ms(_at(now), visibility_ms)).otherwise(F.col("next_run_at")),
        }
    ).select(state.columns)


def allowed(tasks: list[str], throttled: dict[str, datetime], now: datetime) -> list[str]:
    """The tasks that may be claimed now: those that no handler has throttled until later."""
    return [t for t in tasks if t not in throttled or throttled[t] <= now]


def last_n(history: Column, n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(history, F.greatest(F.lit(1), F.size(history) - n + 1), n)


def throttled(outcomes: DataFrame) -> dict[str, datetime]:
    """Until when handlers want their tasks to wait: a row for each task that is throttled at all."""
    return {r.task: r.until for r in outcomes.groupBy("task").agg(F.max("throttle").alias("until")).filter("until is not null").collect()}


def finalize(state: DataFrame, outcomes: DataFrame, now: datetime, retry: RetryPolicy, debounce_ms: int = 1000, history_limit: int = 5) -> DataFrame:
    """The state after outcomes of records that share a policy; see finalize_tasks."""
    return _finalize(state, outcomes, now, retry.gives_up, retry.next_try, F.lit(debounce_ms), F.lit(history_limit))


def finalize_tasks(state: DataFrame, outcomes: DataFrame, now: datetime, definitions: list[TaskDefinition]) -> DataFrame:
    """The state after outcomes of all these tasks, each with its own policy: one join, the policies as a CASE over tasks."""
    if not definitions:
        return state

    def of_task(value: Callable[[TaskDefinition], Column]) -> Column:
        out = None
        for d in definitions:
            x = value(d)
            out = F.when(F.col("task") == d.name, x) if out is None else out.when(F.col("task") == d.name, x)
        return out

    return _finalize(
        state,
        outcomes,
        now,
        lambda tries, first, t: F.coalesce(of_task(lambda d: d.retry.gives_up(tries, first, t)), F.lit(False)),
        lambda tries, t: of_task(lambda d: d.retry.next_try(tries, t)),
        of_task(lambda d: F.lit(d.debounce)),
        F.coalesce(of_task(lambda d: F.lit(d.history_limit)), F.lit(5)),
    )


def _finalize(state: DataFrame, outcomes: DataFrame, now: datetime, gives_up: Callable[..., Column], next_try: Callable[..., Column], debounce_ms: Column, history_limit: Column) -> DataFrame:
    """The state after outcomes (task, source_doc_id, outcome, duration_ms, error, until) of claimed records.

    completed and skipped are successes; failed is retried or given up by the policy; deferred goes back to pending until
    `until` with its attempts forgotten. A record that turned dirty meanwhile is pending again whatever the outcome."""
    out = outcomes.select(*KEYS, F.struct("outcome", F.coalesce("duration_ms", F.lit(0)).cast("long").alias("ms"), F.coalesce("error", F.lit("Unknown error")).alias("error"), "until").alias("__o"))
    both = state.join(out, KEYS, "left")
    o = F.col("__o")
    known, error, later = o.isNotNull(), F.coalesce(o["outcome"] == "failed", F.lit(False)), F.coalesce(o["outcome"] == "deferred", F.lit(False))
    done = known & ~later
    dirty = done & (F.col("status") == "processing_dirty")
    clean = done & ~dirty
    tries = F.coalesce("attempts", F.lit(0))
    first = F.coalesce("first_error_at", _at(now))
    lost = gives_up(tries, first, now)
    entry = F.struct(_at(now).alias("at"), F.when(error, "failed").otherwise("completed").alias("status"), o["ms"].alias("duration_ms"), F.when(error, o["error"]).alias("error")).cast(HISTORY)
    history = last_n(F.concat(F.coalesce("history", F.array().cast(f"array<{HISTORY.simpleString()}>")), F.array(entry)), history_limit)
    keep = F.col
    return both.withColumns(
        {
            "status": F.when(later | dirty, "pending").when(clean & ~error, "completed").when(clean & lost, "failed").when(clean, "pending").otherwise(keep("status")),
            "next_run_at": F.when(later, o["until"]).when(dirty, plus_ms(F.col("updated_at"), debounce_ms)).when(clean & error & ~lost, next_try(tries, now)).when(~clean, keep("next_run_at")),
            "attempts": F.when(later, 0).otherwise(keep("attempts")).cast("int"),
            "completed_at": F.when(clean & ~error, _at(now)).otherwise(keep("completed_at")),
            "first_error_at": F.when(clean & error, first).when(~clean, keep("first_error_at")),
            "last_error": F.when(clean & error, o["error"]).when(~clean, keep("last_error")),
            "last_finalized_at": F.when(done, _at(now)).otherwise(keep("last_finalized_at")),
            "last_success": F.when(done & ~error, F.struct(_at(now).alias("at"), o["ms"].alias("duration_ms"))).otherwise(keep("last_success")),
            "history": F.when(done, history).otherwise(keep("history")),
        }
    ).select(state.columns)


def reset(state: DataFrame, which: Column, now: datetime) -> DataFrame:
    """Run again by hand: busy records turn dirty and keep their lock, others are due now; attempts and due_at stay."""
    hit, busy = F.coalesce(which, F.lit(False)), F.col("status").isin(*BUSY)
    # The predicate is a column of its own first: it may be about the columns that change.
    return state.withColumns({"__hit": hit, "__busy": busy}).withColumns(
        {
            "status": F.when(F.col("__hit") & F.col("__busy"), "processing_dirty").when(F.col("__hit"), "pending").otherwise(F.col("status")),
            "next_run_at": F.when(F.col("__hit") & ~F.col("__busy"), _at(now)).otherwise(F.col("next_run_at")),
            "updated_at": F.when(F.col("__hit"), _at(now)).otherwise(F.col("updated_at")),
        }
    ).select(state.columns)


def retry_by_source(state: DataFrame, source_keys: DataFrame, which: Column, now: datetime) -> DataFrame:
    """Reset records whose source row is among the keys (source_doc_id): one semi join, however many keys."""
    keyed = state.join(source_keys.select("source_doc_id", F.lit(True).alias("__in")).distinct(), "source_doc_id", "left")
    return reset(keyed, F.col("__in").isNotNull() & which, now).select(state.columns)


def still_valid(claimed: DataFrame, current: DataFrame) -> DataFrame:
    """Claimed records whose source row, freshly planned (task, source_doc_id, observed), still matches and is unchanged."""
    c = current.select(*(F.col(k).alias(f"__{k}") for k in KEYS), F.col("observed").alias("__observed"))
    return claimed.join(c, (F.col("task") == F.col("__task")) & (F.col("source_doc_id") == F.col("__source_doc_id")) & F.col("observed").eqNullSafe(F.col("__observed")), "left_semi")


def no_longer_valid(claimed: DataFrame, current: DataFrame) -> DataFrame:
    """The others: their run is skipped and counts as a success."""
    return claimed.join(still_valid(claimed, current).select(*KEYS), KEYS, "left_anti")
