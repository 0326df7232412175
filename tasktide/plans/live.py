"""Queries that run a stream, a batch executor, or a job's transitions, and hold the outcome against SQL."""

from __future__ import annotations

import tempfile
import uuid
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import streaming
from ..operators import cron, handlers, listing, metrics, planner, reconcile, transitions
from ..sources import Sources, StateStore
from .registry import SQL, query
from .sample_state import NOW, REGISTRY, SQL_JOBS, SQL_NOW, SQL_RECORDS, change_events, jobs, records, table
from .tasks import _DUE, _epoch, _instances, _rows


def _folder(spark, name):
    """A new folder that driver and executors share: under spark.checkpoint.dir, or in local mode a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# Streams


def _streamed(spark, sf_dir, start, parts=((0, 1, 2),)):
    """The stored state after a stream over the change events, as files of three parts of the keys, has come to its end; for
    each of the given tuples of parts the stream is started once, and stopped."""
    folder = _folder(spark, "stream")
    before, events = records(spark, sf_dir), change_events(spark, sf_dir)
    store = StateStore(spark, f"{folder}/state", buckets=4)
    store.write(before)
    for run in parts:
        for i in run:
            events.filter(F.pmod(F.xxhash64("key"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        live = streaming.change_stream(spark, f"{folder}/events")
        start(live, Sources.of_parquet(spark, sf_dir, ["orders"]), store, before.limit(0), f"{folder}/checkpoint").awaitTermination()
    return _rows(store.read(before.limit(0)))


def _planner(events, sources, store, empty, checkpoint):
    return streaming.start(events, sources, REGISTRY, store, empty, checkpoint, lambda: NOW)


@query(SQL["cdc_apply_batch"])
def cdc_stream_state(spark, sf_dir):
    """Micro-batches that read and write the buckets of their keys: the same state as the batch path's."""
    return _streamed(spark, sf_dir, _planner)


@query(SQL["cdc_apply_batch"])
def cdc_resume(spark, sf_dir):
    """The stream stops after two batches and is started again from its checkpoint."""
    return _streamed(spark, sf_dir, _planner, ((0, 1), (2,)))


@query(SQL["cdc_apply_batch"].replace("PARTITION BY key ORDER BY", "PARTITION BY key, event_id // ((SELECT max(event_id) + 4 FROM events) // 4) ORDER BY"))
def cdc_follow(spark, sf_dir):
    """A log read by numbers in four batches, of which two are applied by another run: in SQL a key's last event of each batch
    counts."""
    store, before, log = StateStore(spark, f"{_folder(spark, 'follow')}/state", buckets=4), records(spark, sf_dir), change_events(spark, sf_dir)
    store.write(before)
    per_batch = (log.agg(F.max("event_id")).first()[0] + 4) // 4
    for batches in (2, None):
        streaming.follow(log, Sources.of_parquet(spark, sf_dir, ["orders"]), REGISTRY, store, before.limit(0), lambda: NOW, per_batch, batches)
    return _rows(store.read(before.limit(0)))


@query(SQL["reconcile_all"])
def cdc_lost_history(spark, sf_dir):
    """A log in three files by event number, of which the second is gone: the stream finds the hole and reconciles."""
    folder, before, events = _folder(spark, "lost"), records(spark, sf_dir), change_events(spark, sf_dir)
    store = StateStore(spark, f"{folder}/state", buckets=4)
    store.write(before)
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    third = (high - low) // 3
    for a, b in ((low, low + third), (low + 2 * third, high + 1)):
        events.filter(F.col("event_id").between(a, b - 1)).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    live = streaming.change_stream(spark, f"{folder}/events")
    streaming.start(live, Sources.of_parquet(spark, sf_dir, ["orders"]), REGISTRY, store, before.limit(0), f"{folder}/checkpoint", lambda: NOW, sequenced=True).awaitTermination()
    return _rows(store.read(before.limit(0)))


@query(SQL["reconcile_all"])
def cdc_cold_start(spark, sf_dir):
    """Reconciliation, then the stream from a little before. Events are a day older or as old as the overlap: the former are
    left out, and the latter, which are seen twice, change nothing."""
    known = {d.name: reconcile.Control(d.signature(), 1, False) for d in REGISTRY.by_name.values()}

    def start(events, sources, store, empty, checkpoint):
        seen = F.when(F.col("event_id") % 2 == 0, F.lit(NOW - timedelta(days=1))).otherwise(F.lit(NOW - timedelta(seconds=30)))
        return streaming.cold_start(events.withColumn("ts", seen.cast("timestamp_ntz")), sources, REGISTRY, store, empty, checkpoint, lambda: NOW, known)[0]

    return _streamed(spark, sf_dir, start)


@query(SQL["reconcile_all"])
def reconcile_checkpointed(spark, sf_dir):
    """A reconcile in ranges of keys that is stopped behind the second one, and goes on from there in another run."""
    store, before = StateStore(spark, f"{_folder(spark, 'reconcile')}/state", buckets=4), records(spark, sf_dir)
    store.write(before)
    sources, per_range = Sources.of_parquet(spark, sf_dir, ["orders"]), -(-table(spark, sf_dir, "orders").count() // 4)
    asked = iter([False, False, True])
    reconcile.reconcile_checkpointed(sources, REGISTRY, store, before.limit(0), NOW, per_range, lambda: next(asked))
    reconcile.reconcile_checkpointed(sources, REGISTRY, store, before.limit(0), NOW, per_range)
    return _rows(store.read(before.limit(0)))


@query(SQL["cdc_debounce_sessions"])
def stream_debounce(spark, sf_dir):
    """The same from a live stream in four batches; a heartbeat long after closes the last sessions."""
    folder, events = _folder(spark, "debounce"), change_events(spark, sf_dir)
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) / 4
    for i in range(4):
        at_end = F.col("ts") <= F.lit(high).cast("timestamp_ntz") if i == 3 else F.col("ts") < F.lit(low + (i + 1) * step).cast("timestamp_ntz")
        events.filter((F.col("ts") >= F.lit(low + i * step).cast("timestamp_ntz")) & at_end).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    beat = spark.createDataFrame([(-1, high + timedelta(days=9), "heartbeat", -1, "update")], streaming.EVENT)
    beat.coalesce(1).write.mode("append").parquet(f"{folder}/events")
    sessions = streaming.debounced_stream(streaming.change_stream(spark, f"{folder}/events"), "1 hour", "source", "key")
    run = sessions.writeStream.option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/sessions").format("parquet").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(sessions.schema).parquet(f"{folder}/sessions").filter("source <> 'heartbeat'")
    return out.select("key", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("run_at")).alias("run_us"), "events")


@query(SQL["claim_due_topk"])
def claim_due_index(spark, sf_dir):
    """The first due records from the index of a stored state that was written in several versions."""
    store, state = StateStore(spark, f"{_folder(spark, 'due')}/state", buckets=8, part=2_000, most=2), records(spark, sf_dir)
    store.write(state.withColumn("next_run_at", F.lit(NOW - timedelta(days=9000)).cast("timestamp_ntz")))
    for only in ([0, 1], [2], [3, 4, 5], [6, 7]):
        store.write(state.filter(store._bucket(F.col("source_doc_id")).isin(only)), only=only)
    return store.due(NOW, 50).select("task", "source_doc_id")


@query(SQL["reconcile_all"])
def cdc_recover(spark, sf_dir):
    """After lost events everything is planned again, also what counted as reconciled."""
    known = {d.name: reconcile.Control(d.signature(), 1, True) for d in REGISTRY.by_name.values()}
    return _rows(reconcile.recover(lambda name: table(spark, sf_dir, name), REGISTRY, known, records(spark, sf_dir), NOW)[0])


# Claims and batches


@query(f"WITH {SQL_RECORDS} SELECT source_doc_id, attempts FROM records WHERE next_run_at <= {SQL_NOW} AND task = 'urgent_orders' ORDER BY next_run_at, task, source_doc_id LIMIT 50")
def claim_of_instance(spark, sf_dir):
    """The first due records of the tasks that an instance takes, one of them being held back by its handler."""
    tasks = transitions.allowed(["open_orders", "urgent_orders"], {"open_orders": NOW + timedelta(hours=1)}, NOW)
    return transitions.due(records(spark, sf_dir), NOW, 50, tasks).select("source_doc_id", "attempts")


@query("SELECT count(*) AS processed, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN 1 ELSE o_orderkey % 4 END) AS BIGINT) AS performed FROM orders")
def batch_counts(spark, sf_dir):
    """Rows that give no, one or several operations, executed in batches."""
    made = lambda row: None if row["o_orderkey"] % 3 == 0 else row["o_orderkey"] if row["o_orderkey"] % 3 == 1 else [row["o_orderkey"]] * (row["o_orderkey"] % 4)
    counts = handlers.process_in_batches(table(spark, sf_dir, "orders").select("o_orderkey"), made, lambda operations: None, 100)
    return spark.createDataFrame([(counts["processed"], counts["performed"])], "processed long, performed long")


@query("SELECT 'orders' AS source, task, CASE task WHEN 'open_orders' THEN count(*) FILTER (o_orderstatus = 'O') ELSE count(*) FILTER (o_orderpriority = '1-URGENT') END AS records FROM orders, (VALUES ('open_orders'), ('urgent_orders')) t(task) GROUP BY task")
def tasks_of_sources(spark, sf_dir):
    """Each source's tasks, and how many of its rows each of them is for."""
    out = []
    for source, tasks in listing.tasks_by_source(REGISTRY).items():
        rows = planner.fan_out(table(spark, sf_dir, source), [REGISTRY.by_name[t] for t in tasks], NOW)
        out.append(rows.groupBy("task").agg(F.count("*").alias("records")).select(F.lit(source).alias("source"), "task", "records"))
    return reduce(DataFrame.unionByName, out)


# Jobs


@query(
    f"WITH {SQL_JOBS}, s AS (SELECT *, coalesce({_DUE}, FALSE) AND id NOT LIKE '%1' AS ran, coalesce({_DUE}, FALSE) AND id LIKE '%1' AS undone FROM jobs) "
    f"SELECT id, CASE WHEN ran THEN 1 ELSE 0 END + CASE WHEN started_at IS NULL THEN 0 ELSE 1 END AS runs, NOT ran AND run_immediately AS asked, "
    f"CAST(epoch_ms(CASE WHEN ran THEN {SQL_NOW} + INTERVAL 5 MINUTE WHEN NOT undone THEN locked_till END) AS BIGINT) AS lock_ms FROM s"
)
def cron_undo_start(spark, sf_dir):
    """Starts that an instance does not take are taken back: log, lock, and the wish to run by hand."""
    all_jobs = jobs(spark, sf_dir)
    picked = cron.due(all_jobs, NOW).select("id", F.lit(True).alias("hit"), F.col("run_immediately").alias("wish"))
    started = cron.start(all_jobs.join(picked, "id", "left"), F.col("hit").isNotNull(), NOW, NOW + timedelta(minutes=5))
    undone = cron.undo_start(started, F.col("hit").isNotNull() & F.col("id").endswith("1"), F.col("wish"))
    return undone.select("id", F.size("run_log").alias("runs"), F.col("run_immediately").alias("asked"), _epoch("locked_till").alias("lock_ms"))


@query(f"WITH {SQL_JOBS}, t AS (SELECT * REPLACE (run_immediately OR id = 'Supplier#000000002' AS run_immediately) FROM jobs) SELECT id, run_immediately AS asked, coalesce({_DUE}, FALSE) AS due FROM t")
def cron_trigger(spark, sf_dir):
    """A job asked for by hand is due, unless it is locked."""
    asked = cron.trigger(jobs(spark, sf_dir), "Supplier#000000002")
    due = cron.due(asked, NOW).select("id", F.lit(True).alias("due"))
    return asked.join(due, "id", "left").select("id", F.col("run_immediately").alias("asked"), F.coalesce("due", F.lit(False)).alias("due"))


@query(f"WITH {SQL_JOBS} SELECT id, CAST(epoch_ms(run_since) AS BIGINT) AS next_ms FROM jobs WHERE regexp_matches(id, '0[1-4]$', 'i') ORDER BY run_since DESC NULLS LAST, id LIMIT 3 OFFSET 1")
def cron_list_page(spark, sf_dir):
    """The second to fourth of some jobs, the latest first."""
    return cron.listing(jobs(spark, sf_dir), NOW, search="0[1-4]$", sort="run_since", descending=True, limit=3, offset=1).select("id", _epoch("next_run_at").alias("next_ms"))


# Registry


@query("WITH i AS (SELECT event_id % 7 AS id, max(ts) AS seen, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(seen) AS last FROM i) SELECT id, n FROM i, m WHERE id <> 3 AND epoch_ms(last) + 1 - epoch_ms(seen) < 600000 UNION ALL SELECT 3, 0")
def metric_register_stale(spark, sf_dir):
    """Instances not seen for ten minutes leave the registry when another one writes its row."""
    all_ = _instances(spark, sf_dir)
    now = all_.agg(F.max("last_seen").alias("last")).first().last + timedelta(milliseconds=1)
    me = all_.filter("id = 3").withColumns({"metrics": F.slice("metrics", 1, 0), "events": F.lit(0).cast("long")})
    return metrics.register(all_, me, now, 600_000).select("id", F.col("events").alias("n"))
