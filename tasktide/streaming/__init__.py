"""The live path: change events to planned tasks, with the same planner as the batch path.

An event says that a row of a source changed: (event_id, ts, source, key, operation). Its payload isn't used; the row is
read again, so late and repeated events do no harm.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Registry
from ..operators.cleanup import clean_all, clean_source, cleanup_is_due
from ..operators.planner import plan
from ..operators.reconcile import Control, noted, noted_controls, reconcile, recover
from ..sources import Sources, StateStore

EVENT = "event_id long, ts timestamp_ntz, source string, key long, operation string"


def change_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Change events from Parquet files, only the columns that are used."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(folder)


def wanted(events: DataFrame, registry: Registry) -> DataFrame:
    """Events of sources that tasks are defined on. Deletes always pass: they carry no row that a filter could match."""
    return events.filter(F.col("source").isin(registry.sources()) & F.col("operation").isin("insert", "update", "replace", "delete"))


def latest(events: DataFrame, *keys: str) -> DataFrame:
    """The last event of each key (by default of each source and key)."""
    by = keys or ("source", "key")
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def key_ranges(events: DataFrame) -> dict[str, tuple]:
    """The least and greatest key of each source: one small row for each."""
    return {r.source: (r.low, r.high) for r in events.groupBy("source").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()}


def apply_events(events: DataFrame, sources: Callable[[str], DataFrame], registry: Registry, state: DataFrame, now: datetime, ranges: dict[str, tuple] | None = None) -> DataFrame:
    """The state after a batch of events: for each source deletes first, then the changed rows planned as they are now.
    With the ranges of the events' keys, only files and row groups of a source that may hold them are read."""
    last = latest(wanted(events, registry))
    for name in registry.sources():
        if ranges is not None and name not in ranges:
            continue
        tasks, rows = registry.of_source(name), sources(name)
        if ranges is not None:
            rows = rows.filter(F.col(tasks[0].key).between(*ranges[name]))
        mine = last.filter(F.col("source") == name)
        gone = mine.filter("operation = 'delete'").select(F.col("key").alias("source_doc_id"))
        state = clean_source(state, rows, tasks, now, only=gone)
        touched = rows.join(mine.filter("operation <> 'delete'").select(F.col("key").alias(tasks[0].key)), tasks[0].key, "left_semi")
        state = plan(touched, tasks, state, now)
    return state


def missing(rows: DataFrame, token: int | None) -> tuple[int, int] | None:
    """How many numbers are not there between the token (by default the first event) and the last event, and that event's
    number; None if no event is behind the token. event_id numbers a log's events without gaps."""
    behind = F.col("event_id") > F.lit(token) if token is not None else F.lit(True)
    s = rows.filter(behind).agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"), F.count_distinct("event_id").alias("n")).first()
    return None if s.n == 0 else (s.high - (token if token is not None else s.low - 1) - s.n, s.high)


def _commit(rows: DataFrame, sources: Sources, registry: Registry, store: StateStore, empty: DataFrame, now: datetime, batch: int | None, notes: dict[str, Any]) -> None:
    """One commit: the state after a batch of events, and the notes."""
    last = latest(wanted(rows, registry)).persist()
    touched = store.buckets_of(last.select(F.col("key").cast(empty.schema["source_doc_id"].dataType).alias("source_doc_id")))
    if touched:
        ranges = key_ranges(last)
        store.update(lambda state, _: apply_events(last, sources, registry, state, now, ranges), empty, batch, touched, notes)
    elif notes:
        store.note(notes)
    last.unpersist()


def _commit_lost(lost: int, sources: Sources, registry: Registry, store: StateStore, empty: DataFrame, now: datetime, batch: int | None, notes: dict[str, Any]) -> None:
    """One commit: all tasks planned over their whole sources, as that many events are lost, and the notes."""
    base = store.current()
    stored = noted_controls(base)
    controls = recover(sources, registry, stored, empty, now)[1]
    said = notes | {"lost": base.notes.get("lost", 0) + lost} | noted(stored | controls)
    store.update(lambda state, _: recover(sources, registry, stored, state, now)[0], empty, batch, notes=said)


def follow(log: DataFrame, sources: Sources, registry: Registry, store: StateStore, empty: DataFrame, clock: Callable[[], datetime], per_batch: int = 1000, batches: int | None = None, after: int | None = None) -> int:
    """Apply a log's events in order of their numbers, per_batch numbers at a time, to its end or for so many batches; how many
    there were. It begins behind the token that is committed with the state, in a new state behind the number `after` (by
    default with the first event), so a run that stops or dies goes on where its last commit was; there is no other
    checkpoint. Only numbers of the batch and used columns are read. A gap in the numbers is committed as a reconcile of all
    tasks."""
    done = 0
    while batches is None or done < batches:
        token = store.current().notes.get("token", after)
        rest = log.select(*(f.split()[0] for f in EVENT.split(", ")))
        rest = rest if token is None else rest.filter(F.col("event_id") > F.lit(token))
        ends = rest.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).first()
        if ends.high is None:
            break
        token = ends.low - 1 if token is None else token
        upto = min(max(token + per_batch, ends.low), ends.high)
        rows, now = rest.filter(F.col("event_id") <= F.lit(upto)), clock()
        lost = upto - token - rows.agg(F.count_distinct("event_id")).first()[0]
        if lost:
            _commit_lost(lost, sources, registry, store, empty, now, None, {"token": upto})
        else:
            _commit(rows, sources, registry, store, empty, now, None, {"token": upto})
        done += 1
    return done


def start(events: DataFrame, sources: Sources, registry: Registry, store: StateStore, empty: DataFrame, checkpoint: str, clock: Callable[[], datetime], available_now: bool = True, every: str = "500 milliseconds", sequenced: bool = False, cleanup_ms: int | None = None) -> StreamingQuery:
    """Run the planner on a stream. A batch that fails is run again from the checkpoint; one that was written before a crash
    is known by its number and skipped, and a merge of the same rows changes nothing anyway. A batch reads and writes the
    buckets of the state that its keys are in, and of a source what may hold these keys.

    sequenced: event_id numbers the events of the log, whose files come in that order. The number of the last event is
    committed with the state as its token. What is not behind the token was applied before, also by another query with
    another checkpoint, and is left out. Where numbers are missing behind it, changes were lost (their files have expired,
    say): the batch is committed as a reconcile of all tasks over their whole sources, with the token behind it.

    cleanup_ms: every so often a batch is followed by the cleanup of all tasks; when the last one was is committed with the state,
    so the schedule is kept over restarts. An idle source needs a heartbeat."""
    def planned(rows: DataFrame, number: int) -> None:
        base, said = store.current(), {}
        if base.batch >= number:
            return
        if sequenced:
            token = base.notes.get("token")
            found = missing(rows, token)
            if found is None:
                return
            said = {"token": found[1]}
            if token is not None:
                rows = rows.filter(F.col("event_id") > token)
            if found[0]:
                _commit_lost(found[0], sources, registry, store, empty, clock(), number, said)
                return
        _commit(rows, sources, registry, store, empty, clock(), number, said)

    def batch(rows: DataFrame, number: int) -> None:
        planned(rows, number)
        if cleanup_ms is not None:
            now, notes = clock(), store.current().notes
            cleaned = datetime.fromisoformat(notes["cleaned"]) if "cleaned" in notes else None
            if cleanup_is_due(cleaned, now, cleanup_ms):
                store.update(lambda state, _: clean_all(state, sources, registry, now), empty, notes={"cleaned": now.isoformat(), "cleanups": notes.get("cleanups", 0) + 1})

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def cold_start(events: DataFrame, sources: Sources, registry: Registry, store: StateStore, empty: DataFrame, checkpoint: str, clock: Callable[[], datetime], stored: dict[str, Control] | None = None, overlap_ms: int = 60_000, **options: Any) -> tuple[StreamingQuery, dict[str, Control]]:
    """Reconcile all sources, then follow the stream from a little before that began, so that no change falls between; what
    is seen twice changes nothing. The query, and the control rows to store."""
    since = clock()
    base = store.current()
    state, controls = reconcile(sources, registry, stored or {}, store.read(empty, at=base), since)
    store.write(state, base=base)
    fresh = events.filter(F.col("ts") >= F.lit(since - timedelta(milliseconds=overlap_ms)).cast("timestamp_ntz"))
    return start(fresh, sources, registry, store, empty, checkpoint, clock, **options), controls


def debounced(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    """Sessions of each key that end when it is quiet for the gap: when a debounced task of a live stream would run."""
    s = F.session_window("ts", gap)
    return events.groupBy(*keys, s).agg(F.count("*").alias("events")).select(*keys, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("run_at"), "events")


def debounced_stream(events: DataFrame, gap: str, *keys: str, late: str = "0 seconds") -> DataFrame:
    """debounced() of a live stream: each key's open session is state, which its next event within the gap extends; when the
    stream's time (the last event's, less `late`) has passed its end, the session is emitted once and its state is gone.
    Events that are later than `late` are dropped, as their sessions may have been emitted. The time goes on with any event, so
    an idle source needs a heartbeat."""
    # A stream's time has to be an instant: times without a zone are taken as UTC, whatever the session's zone.
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("ts")))
    sessions = debounced(events.withColumn("ts", instant).withWatermark("ts", late), gap, *keys)
    return sessions.withColumns({c: F.timestamp_add("MICROSECOND", F.unix_micros(c), epoch) for c in ("first", "run_at")})


def lag_s(events: DataFrame, now: datetime) -> DataFrame:
    """Seconds between the last event and now, not below 0."""
    late = F.timestamp_diff("SECOND", F.max("ts"), F.lit(now).cast("timestamp_ntz"))
    return events.agg(F.greatest(F.lit(0), F.coalesce(late, F.lit(0))).cast("long").alias("lag_s"))
