"""Operators on small states with a fixed clock: the status machine, cleanup, evolution, the stream, handlers."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tasktide import streaming
from tasktide.model import CleanupPolicy, Evolution, Registry, RetryPolicy, TaskDefinition, record_schema
from tasktide.operators import cleanup, cron, listing, metrics, planner, reconcile, transitions
from tasktide.operators.handlers import Defer, Skip, Throttle, process_in_batches, run_handlers
from tasktide.operators.worker import Worker, key_ranges, outcomes
from tasktide.sources import Conflict, Sources, StateStore

NOW = datetime(2024, 5, 1)
LATER = NOW + timedelta(hours=2)
SOURCE = "id long, kind string, price long"
TASK = TaskDefinition("t", "src", "id", {"kind": "a"}, {"price": 1}, cleanup=CleanupPolicy(keep_for=0))


@pytest.fixture(scope="module")
def schema(spark):
    return record_schema(observed=spark.createDataFrame([], "observed struct<price:bigint>").schema["observed"].dataType)


@pytest.fixture(scope="module")
def empty(spark, schema):
    return spark.createDataFrame([], schema)


def source(spark, *rows):
    return spark.createDataFrame(list(rows), SOURCE)


def by_id(state):
    return {r.source_doc_id: r for r in state.collect()}


def made(spark, schema, **fields):
    """A state of one record."""
    base = dict.fromkeys(schema.fieldNames()) | {"task": "t", "source_doc_id": 1, "status": "pending", "attempts": 0, "next_run_at": NOW, "due_at": NOW, "created_at": NOW, "updated_at": NOW, "observed": (5,), "reset_on_change": True}
    return spark.createDataFrame([tuple((base | fields)[c] for c in schema.fieldNames())], schema)


def test_planning_inserts_changes_and_leaves_alone(spark, empty):
    state = planner.plan(source(spark, (1, "a", 5), (2, "b", 5), (3, "a", 7)), [TASK], empty, NOW)
    first = by_id(state)
    assert set(first) == {1, 3} and first[1].status == "pending" and first[1].attempts == 0
    assert first[1].next_run_at == first[1].due_at == NOW + timedelta(seconds=1) and first[1].created_at == NOW
    second = by_id(planner.plan(source(spark, (1, "a", 6), (3, "a", 7), (4, "a", 1)), [TASK], state, LATER))
    assert second[1].due_at == LATER + timedelta(seconds=1) and second[1].updated_at == LATER and second[1].created_at == NOW
    assert second[3] == first[3] and second[4].created_at == LATER
    left = by_id(planner.plan(source(spark, (1, "b", 9)), [TASK], state, LATER))
    assert left == first


@pytest.mark.parametrize(("status", "after", "keeps_lock"), [("pending", "pending", False), ("completed", "pending", False), ("failed", "pending", False), ("processing", "processing_dirty", True), ("processing_dirty", "processing_dirty", True)])
def test_changes_by_status(spark, schema, status, after, keeps_lock):
    state = made(spark, schema, status=status, attempts=3, last_error="e", first_error_at=NOW)
    r = by_id(planner.plan(source(spark, (1, "a", 6)), [TASK], state, LATER))[1]
    assert (r.status, r.attempts, r.last_error, r.first_error_at) == (after, 0, None, None)
    assert r.next_run_at == (NOW if keeps_lock else LATER + timedelta(seconds=1))
    keep = TaskDefinition("t", "src", "id", {"kind": "a"}, {"price": 1}, retry=RetryPolicy(reset_on_change=False))
    r = by_id(planner.plan(source(spark, (1, "a", 6)), [keep], state, LATER))[1]
    assert (r.attempts, r.last_error, r.first_error_at) == (0, "e", NOW)


def test_many_definitions_share_one_scan(spark, tmp_path):
    source(spark, (1, "a", 5)).write.parquet(f"file://{tmp_path}/s")
    rows = spark.read.parquet(f"file://{tmp_path}/s")
    tasks = [TaskDefinition(f"t{i}", "src", "id", {"price": {"$gt": i}}, {"price": 1}) for i in range(8)]
    found = planner.fan_out(rows, tasks, NOW)
    assert found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "PushedFilters: [Or(" in plan
    mixed = planner.fan_out(rows, [TASK, TaskDefinition("w", "src", "id", None, {"kind": 1})], NOW)
    assert {r.task: r.observed for r in mixed.collect()} == {"t": '{"price":5}', "w": '{"kind":"a"}'}


def test_claims_take_the_first_due_and_expired_locks(spark, schema):
    rows = [made(spark, schema, source_doc_id=i, next_run_at=NOW + timedelta(minutes=i) if i < 8 else None, status="processing" if i == 0 else "pending") for i in range(9)]
    state = rows[0]
    for r in rows[1:]:
        state = state.unionByName(r)
    now = NOW + timedelta(minutes=4)
    got = by_id(transitions.claim(state, now, 3))
    assert [i for i in got if got[i].started_at == now] == [0, 1, 2] and got[0].attempts == 1 and got[2].status == "processing"
    assert got[1].next_run_at == now + timedelta(minutes=1) and got[3].status == "pending" and len(got) == 9
    assert "TakeOrderedAndProject" in transitions.due(state, now, 3)._jdf.queryExecution().executedPlan().toString()
    assert transitions.due(state, now, 9, tasks=["other"]).count() == 0


def test_what_is_due_reaches_the_scan(spark, schema, empty, tmp_path):
    state = made(spark, schema, next_run_at=NOW)
    store = StateStore(spark, f"file://{tmp_path}/state", 2)
    store.write(state)
    plan = transitions.due(store.read(empty), NOW, 5, ["t"])._jdf.queryExecution().toString()
    assert "LessThanOrEqual(next_run_at" in plan


def outcome(spark, kind, error=None, until=None, ms=7):
    return spark.createDataFrame([("t", 1, kind, ms, error, until)], "task string, source_doc_id long, outcome string, duration_ms long, error string, until timestamp_ntz")


def test_finalizing(spark, schema):
    policy = RetryPolicy("fixed", interval="1m", max_attempts=3)
    done = lambda state, *o: by_id(transitions.finalize(state, outcome(spark, *o), LATER, policy))[1]
    busy = made(spark, schema, status="processing", attempts=1, last_error="old", first_error_at=NOW)
    r = done(busy, "completed")
    assert (r.status, r.next_run_at, r.completed_at, r.last_error, r.first_error_at, r.last_finalized_at) == ("completed", None, LATER, None, None, LATER)
    assert r.last_success.duration_ms == 7 and [(h.status, h.error) for h in r.history] == [("completed", None)]
    assert done(busy, "skipped").status == "completed"
    r = done(busy, "failed", "boom")
    assert (r.status, r.next_run_at, r.last_error, r.first_error_at, r.completed_at) == ("pending", LATER + timedelta(minutes=1), "boom", NOW, None)
    assert [(h.status, h.error) for h in r.history] == [("failed", "boom")]
    assert done(made(spark, schema, status="processing", attempts=1), "failed", "x").first_error_at == LATER
    r = done(made(spark, schema, status="processing", attempts=3), "failed", None)
    assert (r.status, r.next_run_at, r.last_error) == ("failed", None, "Unknown error")
    r = done(made(spark, schema, status="processing_dirty", attempts=1, last_error="old"), "completed")
    assert (r.status, r.next_run_at, r.attempts, r.last_error, r.completed_at) == ("pending", NOW + timedelta(seconds=1), 1, "old", None)
    assert len(r.history) == 1 and r.last_success is not None
    r = done(busy, "deferred", None, LATER + timedelta(days=1))
    assert (r.status, r.next_run_at, r.attempts, r.due_at, r.history) == ("pending", LATER + timedelta(days=1), 0, NOW, None)


def test_history_keeps_the_last(spark, schema):
    state = made(spark, schema, status="processing")
    for i in range(7):
        state = transitions.finalize(state, outcome(spark, "completed", None, None, i), LATER, RetryPolicy())
    assert [h.duration_ms for h in by_id(state)[1].history] == [2, 3, 4, 5, 6]


def test_resets(spark, schema):
    r = by_id(transitions.reset(made(spark, schema, status="failed", attempts=4, next_run_at=None), F.col("status") == "failed", LATER))[1]
    assert (r.status, r.next_run_at, r.updated_at, r.attempts, r.due_at) == ("pending", LATER, LATER, 4, NOW)
    r = by_id(transitions.reset(made(spark, schema, status="processing"), F.lit(True), LATER))[1]
    assert (r.status, r.next_run_at, r.updated_at) == ("processing_dirty", NOW, LATER)
    r = by_id(transitions.reset(made(spark, schema), F.col("last_error") == "x", LATER))[1]
    assert r.updated_at == NOW
    keys = spark.createDataFrame([(1,), (1,)], "source_doc_id long")
    assert by_id(transitions.retry_by_source(made(spark, schema, status="completed"), keys, F.lit(True), LATER))[1].status == "pending"


def test_cleanup_policies(spark, schema):
    state = made(spark, schema)
    gone, other, same = source(spark, (2, "a", 5)), source(spark, (1, "b", 5)), source(spark, (1, "a", 5))

    def left(when, rows, keep_for=0, now=LATER, only=None):
        d = TaskDefinition("t", "src", "id", {"kind": "a"}, cleanup=CleanupPolicy(when, keep_for))
        return cleanup.clean(state, rows, d, now, only).count()

    assert left("source_deleted", gone) == 0 and left("source_deleted", other) == 1 and left("never", gone) == 1
    assert left("source_deleted_or_not_matching", other) == 0 and left("source_deleted_or_not_matching", same) == 1
    assert left("source_deleted", gone, "1d") == 1 and left("source_deleted", gone, 0, NOW) == 1
    assert left("source_deleted", gone, only=spark.createDataFrame([(9,)], "source_doc_id long")) == 1
    assert "LeftAnti" in cleanup.orphans(state, gone, TASK, LATER)._jdf.queryExecution().toString()


def test_cleanup_of_rows_that_time_excludes(spark, schema):
    rows = spark.createDataFrame([(1, LATER)], "id long, expires timestamp_ntz")
    d = TaskDefinition("t", "src", "id", {"$expr": {"$gt": ["$expires", "$$NOW"]}}, cleanup=CleanupPolicy("source_deleted_or_not_matching", 0))
    assert cleanup.clean(made(spark, schema), rows, d, NOW + timedelta(hours=1)).count() == 1
    assert cleanup.clean(made(spark, schema), rows, d, LATER + timedelta(hours=1)).count() == 0


def test_late_binding(spark, schema):
    claimed = made(spark, schema)
    for rows, valid in ((source(spark, (1, "a", 5)), 1), (source(spark, (1, "a", 6)), 0), (source(spark, (1, "b", 5)), 0), (source(spark, (2, "a", 5)), 0)):
        now = planner.fan_out(rows, [TASK], NOW)
        assert transitions.still_valid(claimed, now).count() == valid and transitions.no_longer_valid(claimed, now).count() == 1 - valid


def test_evolution(spark, schema, empty):
    wide = TaskDefinition("t", "src", "id", {"kind": {"$in": ["a", "b"]}}, {"price": 1})
    stored = {"t": reconcile.Control(TASK.signature(), 1, True)}
    assert reconcile.trigger_changes(Registry(TASK), stored)["t"].reconciled
    assert not reconcile.trigger_changes(Registry(wide), stored)["t"].reconciled
    out = TaskDefinition("t", "src", "id", {"kind": "b"}, evolution=Evolution(reconcile_on_trigger_change=False))
    found = reconcile.trigger_changes(Registry(out), stored)["t"]
    assert found.reconciled and found.signature == out.signature()
    rows = source(spark, (1, "a", 5), (2, "b", 6))
    state, controls = reconcile.reconcile(lambda _: rows, Registry(wide), stored, made(spark, schema), LATER)
    assert set(by_id(state)) == {1, 2} and controls["t"].reconciled
    state, _ = reconcile.reconcile(lambda _: rows, Registry(TASK), stored, empty, LATER)
    assert state.count() == 0
    for on, status, runs in (("none", "failed", False), ("reprocess_failed", "failed", True), ("reprocess_failed", "completed", False), ("reprocess_all", "completed", True)):
        d = TaskDefinition("t", "src", "id", {"kind": "a"}, {"price": 1}, evolution=Evolution(2, on))
        state, controls = reconcile.reconcile(lambda _: rows, Registry(d), stored, made(spark, schema, status=status), LATER)
        assert (by_id(state)[1].status == "pending") == runs and controls["t"].version == 2
    older = TaskDefinition("t", "src", "id", evolution=Evolution(0, "reprocess_all"))
    assert reconcile.upgrade_scope(older, stored["t"], True) is None
    assert reconcile.upgrade_scope(TaskDefinition("n", "src", "id", evolution=Evolution(1, "reprocess_all")), None, False) is None
    assert reconcile.upgrade_scope(TaskDefinition("n", "src", "id", evolution=Evolution(1, "reprocess_all")), None, True) is not None


def test_resuming(spark):
    rows = source(spark, *((i, "a", 1) for i in range(50)))
    assert [r.id for r in reconcile.keys_after(rows, "id", reconcile.resume_after(({"t"}, 24), {"t"})).collect()] == list(range(25, 50))
    assert reconcile.resume_after(({"u"}, 24), {"t"}) is None and reconcile.resume_after(({"t"}, 0), {"t"}) == 0 and reconcile.resume_after(None, {"t"}) is None


def test_lists(spark, schema):
    a = made(spark, schema, last_error="Timeout")
    b = made(spark, schema, source_doc_id=2, next_run_at=None, status="failed", last_error="timeout x")
    c = made(spark, schema, source_doc_id=3, task="u", next_run_at=NOW - timedelta(hours=1), status="processing_dirty")
    state = listing.union([a.unionByName(b), c])
    assert [r.source_doc_id for r in listing.page(state).collect()] == [3, 1, 2]
    assert [r.source_doc_id for r in listing.page(state, descending=True, limit=1, offset=1).collect()] == [3]
    ids = lambda **q: sorted(r.source_doc_id for r in listing.matching(state, listing.TaskQuery(**q)).collect())
    assert ids(has_error=True) == [1, 2] and ids(has_error=False) == [3] and ids(error="^TIME") == [1, 2] and ids(error="x$", has_error=True, status="failed") == [2]
    assert ids(task="u") == [3] and ids(source_doc_id=2) == [2] and ids(status=["pending"]) == [1]
    rows = source(spark, (1, "a", 5), (2, "b", 5))
    assert listing.matching(state, listing.TaskQuery(source_filter={"kind": "a"}), rows, "id").first().source_doc_id == 1
    assert listing.matching(state, listing.TaskQuery(source_filter={"id": 2}), rows, "id").first().source_doc_id == 2
    with pytest.raises(ValueError):
        listing.page(state, sort="odd")
    info = {r.task: (r.processing, r.pending, r.error) for r in listing.info(state, Registry(TASK, TaskDefinition("none", "src", "id"))).collect()}
    assert info == {"none": (0, 0, 0), "t": (0, 1, 2)}
    total = {r.level: r.n for r in listing.facet(state).filter("level = 'all'").collect()}
    assert total == {"all": 3} and listing.tasks_by_source(Registry(TASK)) == {"src": ["t"]}
    text = c.withColumn("source_doc_id", F.lit("x"))
    assert sorted(r.source_doc_id for r in listing.union([a, text]).collect()) == ["1", "x"]


def test_overview_and_retry_by_query(spark, schema):
    state = made(spark, schema, last_error="Timeout").unionByName(made(spark, schema, source_doc_id=2, status="failed", next_run_at=None)).unionByName(made(spark, schema, source_doc_id=3, task="u"))
    registry = Registry(TASK, TaskDefinition("u", "src", "id"))
    page, total, counts = listing.overview(state, listing.TaskQuery(task="t", status="failed"), limit=5)
    assert [r.source_doc_id for r in page.collect()] == [2] and total.first().total == 1
    assert {r.status: r.n for r in counts.collect()} == {"failed": 1, "pending": 1} and "observed" not in page.columns
    hit = lambda q: {r.source_doc_id for r in listing.retry(state, registry, q, LATER, lambda _: source(spark, (1, "a", 5), (3, "b", 6))).filter(F.col("updated_at") == F.lit(LATER).cast("timestamp_ntz")).collect()}
    assert hit(listing.TaskQuery()) == {1, 2, 3} and hit(listing.TaskQuery(task="t")) == {1, 2} and hit(listing.TaskQuery(status="failed")) == {2}
    assert hit(listing.TaskQuery(source_filter={"kind": "b"})) == {3} and hit(listing.TaskQuery(task="t", source_filter={"kind": "b"})) == set()
    with pytest.raises(KeyError):
        listing.retry(state, registry, listing.TaskQuery(task="odd"), LATER)
    assert transitions.allowed(["a", "b", "c"], {"a": LATER, "b": NOW}, NOW) == ["b", "c"]


def test_control_table_and_recovery(spark, schema, empty):
    stored = {"t": reconcile.Control(TASK.signature(), 1, True, NOW)}
    assert reconcile.from_frame(reconcile.to_frame(spark, stored)) == stored
    rows = source(spark, (1, "a", 5))
    assert reconcile.reconcile(lambda _: rows, Registry(TASK), stored, empty, LATER)[0].count() == 0
    state, controls = reconcile.recover(lambda _: rows, Registry(TASK), stored, empty, LATER)
    assert set(by_id(state)) == {1} and controls["t"].last_reconciled_at == LATER
    assert cleanup.clean_all(made(spark, schema, source_doc_id=9), lambda _: rows, Registry(TASK), LATER).count() == 0
    assert {r.task: r.seconds for r in metrics.last_reconciled(reconcile.to_frame(spark, {"x": reconcile.Control()})).collect()} == {"x": 0}


def test_jobs(spark):
    hour = timedelta(hours=1)
    rows = [
        ("a", "1h", NOW - hour, False, None, [(NOW - hour, NOW - hour, None)]),
        ("b", "1h", NOW + hour, True, None, []),
        ("c", "1h", NOW - 2 * hour, False, NOW + hour, []),
        ("d", "1h", NOW + 3 * hour, False, NOW - hour, [(NOW - hour, None, "bad")]),
    ]
    jobs = spark.createDataFrame(rows, cron.SCHEMA)
    assert [r.id for r in cron.due(jobs, NOW).collect()] == ["b", "a"]
    assert {r.id: r.status for r in cron.listing(jobs, NOW).collect()} == {"a": "idle", "b": "scheduled", "c": "running", "d": "failed"}
    assert [r.id for r in cron.listing(jobs, NOW, search="[AB]", descending=True, limit=1, offset=1).collect()] == ["a"]
    assert {r.id: r.duration_ms for r in cron.listing(jobs, NOW).collect()}["d"] == 3_600_000
    assert cron.next_wait_ms(jobs, NOW).first().wait_ms == 0 and cron.next_wait_ms(jobs.filter("id = 'd'"), NOW).first().wait_ms == 5000
    for i in range(7):
        jobs = cron.start(jobs, F.col("id") == "a", NOW + i * hour, NOW)
    log = jobs.filter("id = 'a'").first().run_log
    assert [x.started_at for x in log] == [NOW + i * hour for i in (6, 5, 4, 3, 2)]
    undone = cron.undo_start(jobs, F.col("id") == "a").filter("id = 'a'").first()
    assert len(undone.run_log) == 4 and undone.run_log[0].started_at == NOW + 5 * hour and undone.locked_till is None
    assert cron.trigger(jobs, "a").filter("id = 'a'").first().run_immediately
    new = cron.insert_missing(jobs, spark.createDataFrame([("a", "9h", NOW), ("e", "1h", NOW)], "id string, interval string, run_since timestamp_ntz"))
    found = {r.id: r for r in new.collect()}
    assert len(found) == 5 and found["a"].interval == "1h" and found["e"].run_log == [] and found["e"].run_immediately is False


def test_metrics(spark, schema):
    runs = spark.createDataFrame([(NOW, "t", "completed", 20, 1), (NOW, "t", "completed", 700, 2), (NOW, "t", "failed", 99_000, 3)], "ts timestamp_ntz, task string, status string, duration_ms long, attempts int")
    h = {(r.status, r.le): r.n for r in metrics.histogram(runs).collect()}
    assert h["completed", "+Inf"] == 2 and h["completed", "0.025"] == 1 and h["completed", "0.01"] == 0 and h["failed", "10.0"] == 0 and h["failed", "+Inf"] == 1
    assert metrics.retries(runs).first().retries == 2
    state = made(spark, schema, due_at=NOW - timedelta(seconds=10), next_run_at=LATER)
    assert metrics.lag(state, NOW).first().lag_s == 10 and metrics.lag(state, NOW - timedelta(hours=1)).first().lag_s == 0
    assert metrics.health(runs).first().score == pytest.approx(66.667, abs=0.001)
    samples = spark.createDataFrame([(NOW, 5.0), (NOW + timedelta(seconds=1), 8.0), (NOW + timedelta(seconds=2), 2.0)], "ts timestamp_ntz, value double").withColumn("s", F.lit(1))
    assert [r.increase for r in metrics.increase(samples, ["s"]).orderBy("ts").collect()] == [0.0, 3.0, 2.0]
    registry = spark.createDataFrame([("a", NOW, [("runs", {"task": "t"}, 5.0)]), ("b", NOW - timedelta(hours=2), [("runs", {"task": "t"}, 1.0)])], "id string, last_seen timestamp_ntz, metrics array<struct<name:string,labels:map<string,string>,value:double>>")
    assert metrics.cluster(registry).first().value == 6.0
    me = registry.filter("id = 'a'")
    assert metrics.register(registry, me, NOW).count() == 2 and metrics.register(registry, me, NOW, 3_600_000).count() == 1


def test_handlers(spark, schema):
    claimed = made(spark, schema)
    for i in range(2, 5):
        claimed = claimed.unionByName(made(spark, schema, source_doc_id=i))

    def handler(record):
        i = record["source_doc_id"]
        if i == 2:
            raise ValueError("boom")
        if i == 3:
            raise Defer(datetime(2030, 1, 1))
        if i == 4:
            raise Skip

    got = run_handlers(claimed.select("task", "source_doc_id"), handler)
    assert {r.source_doc_id: (r.outcome, r.error) for r in got.collect()} == {1: ("completed", None), 2: ("failed", "boom"), 3: ("deferred", None), 4: ("skipped", None)}
    end = by_id(transitions.finalize(claimed.withColumn("status", F.lit("processing")), got, LATER, RetryPolicy()))
    assert [end[i].status for i in range(1, 5)] == ["completed", "pending", "pending", "completed"] and end[3].next_run_at == datetime(2030, 1, 1)


def test_batches(spark):
    rows = spark.range(0, 25, 1, 1)
    assert process_in_batches(rows, lambda r: r["id"], lambda ops: None, 10) == {"processed": 25, "performed": 25}
    assert process_in_batches(rows, lambda r: None if r["id"] % 2 else [r["id"]] * 2, lambda ops: None, 10) == {"processed": 25, "performed": 26}
    assert process_in_batches(rows.limit(0), lambda r: 1, lambda ops: None) == {"processed": 0, "performed": 0}


def test_the_stream_does_what_a_batch_does(spark, schema, empty, tmp_path):
    rows = source(spark, (1, "a", 5), (2, "a", 6), (3, "b", 7), (5, "a", 8))
    events = [(1, NOW, "src", 1, "insert"), (2, NOW, "src", 2, "update"), (3, NOW + timedelta(seconds=1), "src", 2, "update"), (4, NOW, "src", 4, "delete"), (5, NOW, "other", 5, "insert"), (6, NOW, "src", 3, "insert")]
    frame = spark.createDataFrame(events, streaming.EVENT)
    folder = f"file://{tmp_path}/events"
    frame.filter("event_id <= 3").coalesce(1).write.mode("append").parquet(folder)
    frame.filter("event_id > 3").coalesce(1).write.mode("append").parquet(folder)
    sources, registry = Sources(spark, {"src": lambda s: rows}), Registry(TASK)
    store = StateStore(spark, f"file://{tmp_path}/state")
    store.write(made(spark, schema, source_doc_id=4, updated_at=NOW - timedelta(days=1)))
    for _ in range(2):  # the second run finds nothing new
        q = streaming.start(streaming.change_stream(spark, folder), sources, registry, store, empty, f"file://{tmp_path}/check", lambda: LATER)
        q.awaitTermination(120)
        assert q.exception() is None
    live = by_id(store.read(empty))
    batch = by_id(streaming.apply_events(frame, sources, registry, made(spark, schema, source_doc_id=4, updated_at=NOW - timedelta(days=1)), LATER))
    assert live == batch and set(live) == {1, 2}
    assert store.current()[0] == 3
    with pytest.raises(KeyError):
        sources("missing")


def test_latest_events_and_sessions(spark):
    at = lambda s: NOW + timedelta(seconds=s)
    rows = spark.createDataFrame([(1, at(0), "s", 1, "insert"), (2, at(5), "s", 1, "update"), (3, at(5), "s", 1, "delete"), (4, at(60), "s", 1, "update"), (5, at(0), "u", 1, "insert")], streaming.EVENT)
    assert {(r.source, r.event_id) for r in streaming.latest(rows).collect()} == {("s", 4), ("u", 5)}
    assert sorted((r.source, r.run_at, r.events) for r in streaming.debounced(rows, "10 seconds", "source").collect()) == [("s", at(15), 3), ("s", at(70), 1), ("u", at(10), 1)]
    assert streaming.lag_s(rows, at(90)).first().lag_s == 30


def test_cleanup_of_many_tasks_is_one_join(spark, schema):
    """Fifty tasks are planned at once: one read of the state and one of the source."""
    tasks = [TaskDefinition(f"t{i}", "src", "id", {"price": {"$gt": i}}, {"price": 1}, cleanup=CleanupPolicy(("source_deleted", "source_deleted_or_not_matching", "never")[i % 3], 0)) for i in range(50)]
    rows = source(spark, (1, "a", 20), (2, "b", 40))
    state = made(spark, schema, task="t0")
    for i in range(50):
        for key in (1, 2, 9):
            state = state.unionByName(made(spark, schema, task=f"t{i}", source_doc_id=key)) if i < 8 else state
    began = time.perf_counter()
    out = cleanup.clean_all(state.filter("source_doc_id > 0"), lambda _: rows, Registry(*tasks), LATER)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert time.perf_counter() - began < 5 and plan.count("Join") <= 2
    left = {(r.task, r.source_doc_id) for r in out.collect()}
    kept = {"source_deleted": lambda i, k: k != 9, "source_deleted_or_not_matching": lambda i, k: k != 9 and {1: 20, 2: 40}[k] > i, "never": lambda i, k: True}
    assert left == {(f"t{i}", k) for i in range(8) for k in (1, 2, 9) if kept[tasks[i].cleanup.delete_when](i, k)}
    state, _ = reconcile.reconcile(lambda _: rows, Registry(*tasks), {}, made(spark, schema, task="t1", source_doc_id=9), LATER)
    assert state.count() == 20 + 40 and cleanup.cleanup_is_due(None, NOW, 1) and not cleanup.cleanup_is_due(NOW, NOW, 1)


def test_jobs_start_and_finish(spark):
    hour = timedelta(hours=1)
    rows = [("a", "1h", NOW - hour, True, None, []), ("b", "CRON 0 12 * * *", NOW - hour, False, None, [(NOW - 9 * hour, NOW - 8 * hour, None)]), ("c", "5000", NOW - hour, False, None, None), ("d", None, NOW + hour, None, None, [])]
    jobs = spark.createDataFrame(rows, cron.SCHEMA)
    started = cron.start(jobs, F.col("run_immediately") | (F.col("run_since") <= F.lit(NOW)), NOW, NOW + hour)
    assert [r.id for r in cron.due(started, NOW).collect()] == []
    assert {r.id: (r.run_immediately, r.locked_till) for r in started.collect()} == {"a": (False, NOW + hour), "b": (False, NOW + hour), "c": (False, NOW + hour), "d": (False, None)}
    again = cron.undo_start(started.join(jobs.select("id", F.col("run_immediately").alias("was")), "id"), F.col("id") == "a", F.col("was")).filter("id = 'a'").first()
    assert again.run_immediately and again.locked_till is None and again.run_log == []
    outcomes = spark.createDataFrame([("a", None), ("b", "boom"), ("c", None)], "id string, error string")
    done = {r.id: r for r in cron.finish(started, outcomes, NOW + timedelta(minutes=1)).collect()}
    assert done["a"].run_since == NOW + hour + timedelta(minutes=1) and done["c"].run_since == NOW + timedelta(minutes=1, seconds=5)
    assert done["b"].run_since > NOW and done["b"].run_since.hour == 12 and done["d"].run_since == NOW + hour
    assert [(x.started_at, x.finished_at, x.error) for x in done["b"].run_log] == [(NOW, NOW + timedelta(minutes=1), "boom"), (NOW - 9 * hour, NOW - 8 * hour, None)]
    assert {r.id: r.status for r in cron.listing(cron.finish(started, outcomes, NOW), NOW).collect()} == {"a": "idle", "b": "failed", "c": "idle", "d": "idle"}
    given = cron.finish(started, outcomes.withColumn("next_run", F.lit(LATER).cast("timestamp_ntz")), NOW)
    assert {r.run_since for r in given.filter("id <> 'd'").collect()} == {LATER}


def test_handlers_of_many_tasks_throttle_and_wait(spark, schema):
    claimed = made(spark, schema, task="a").unionByName(made(spark, schema, task="b")).unionByName(made(spark, schema, task="b", source_doc_id=2)).unionByName(made(spark, schema, task="b", source_doc_id=3))

    def slow(record):
        if record["source_doc_id"] == 2:
            raise Throttle(LATER)
        if record["source_doc_id"] == 3:
            raise Defer("1m", throttle="2m")

    def around(run):
        run()
        raise RuntimeError("after")

    said = {(r.task, r.source_doc_id): r for r in run_handlers(claimed, {"a": lambda r: Throttle("10s"), "b": slow}, NOW).collect()}
    assert said["a", 1].outcome == "completed" and said["a", 1].throttle == NOW + timedelta(seconds=10) and said["b", 1].throttle is None
    assert said["b", 2].throttle == LATER and said["b", 3].outcome == "deferred" and said["b", 3].until == NOW + timedelta(minutes=1) and said["b", 3].throttle == NOW + timedelta(minutes=2)
    assert {r.error for r in run_handlers(claimed, lambda r: None, NOW, around).collect()} == {"after"}


def test_worker_claims_runs_and_finalizes(spark, schema, empty, tmp_path):
    calls = f"{tmp_path}/calls"

    def handler(record):
        with open(calls, "a") as f:
            f.write(f"{record['task']} {record['source_doc_id']} {record['document']['price']}\n")
        if record["source_doc_id"] == 2:
            raise ValueError("boom")
        if record["source_doc_id"] == 5:
            raise Throttle("1h")

    rows = source(spark, (1, "a", 5), (2, "a", 6), (4, "a", 9), (5, "a", 5))
    sources = Sources(spark, {"src": lambda s: rows})
    task = TaskDefinition("t", "src", "id", {"kind": "a"}, {"price": 1}, handler=handler, retry=RetryPolicy("fixed", interval="1h"))
    other = TaskDefinition("u", "src", "id", {"kind": "a"}, {"price": 1}, handler=lambda r: None)
    state = planner.plan(rows, [task, other], empty, NOW).unionByName(made(spark, schema, source_doc_id=3, next_run_at=NOW))
    state = state.withColumn("observed", F.when(F.col("source_doc_id") == 4, F.struct(F.lit(8).cast("long").alias("price"))).otherwise(F.col("observed")))
    at = [LATER]
    store = StateStore(spark, f"file://{tmp_path}/state", 4)
    store.write(state)
    worker = Worker(store, sources, Registry(task, other), empty, lambda: at[0], n=100)
    assert worker.round() == 9 and worker.round() == 0
    assert sorted(open(calls).read().split("\n")[:-1]) == ["t 1 5", "t 2 6", "t 5 5"]
    end = {(r.task, r.source_doc_id): r for r in store.read(empty).collect()}
    assert end["t", 1].status == "completed" and end["t", 2].status == "pending" and end["t", 2].last_error == "boom" and end["t", 3].status == end["t", 4].status == "completed" and end["u", 2].status == "completed"
    assert worker.waiting == {"t": LATER + timedelta(hours=1)}
    at[0] = LATER + timedelta(minutes=61)
    assert worker.round() == 1 and open(calls).read().count("t 2 6") == 2
    assert [n for n in store._names("scratch")] == []


def test_a_batch_reads_and_writes_its_buckets_only(spark, schema, empty, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/state", 32)
    rows = spark.range(400).select(F.col("id"), F.lit("a").alias("kind"), (F.col("id") % 7).cast("long").alias("price"))
    rows = rows.select(*(F.col(c).cast(t) for c, t in source(spark, (1, "a", 5)).dtypes))
    store.write(planner.plan(rows, [TASK], empty, NOW))
    assert len(store.current()[1]) == 32 and store.read(empty).count() == 400
    before = dict(store.current()[1])
    for keys in ([5], [5, 6, 7, 8]):
        touched = store.buckets_of(spark.createDataFrame([(k,) for k in keys], "source_doc_id long"))
        assert len(touched) <= len(keys)
        part = store.read(empty, touched)
        assert part.count() < 400 * (len(keys) + 1) / 16
        store.write(planner.plan(rows.filter(F.col("id").isin(keys)), [TASK], part, LATER), 7, touched)
        changed = {b for b, f in store.current()[1].items() if before[b] != f}
        assert changed == set(touched) and store.read(empty).count() == 400 and store.current()[2] == 7
        before = dict(store.current()[1])
    store.write(store.read(empty, [0]).limit(0), 8, [0])
    assert 0 not in store.current()[1] and store.read(empty).count() < 400
    n = store.read(empty).count()
    store.expire(1)
    assert store._versions() == [4] and store.read(empty).count() == n
    kept = sum(len([x for x in store._names(f"data/{d}") if x.startswith("bucket=")]) for d in store._names("data"))
    assert kept == len(store.current()[1]) == 31


def test_events_of_a_narrow_range_read_a_part_of_the_source(spark, schema, empty, tmp_path):
    spark.range(0, 4000, 1, 8).select("id", F.lit("a").alias("kind"), F.lit(1).cast("long").alias("price")).write.parquet(f"{tmp_path}/src.parquet")
    sources = Sources.of_parquet(spark, str(tmp_path), ["src"])
    events = spark.createDataFrame([(1, NOW, "src", 10, "insert"), (2, NOW, "src", 20, "delete")], streaming.EVENT)
    out = streaming.apply_events(events, sources, Registry(TASK), empty, LATER, streaming.key_ranges(events))
    assert set(by_id(out)) == {10} and "GreaterThanOrEqual(id,10), LessThanOrEqual(id,20)" in out._jdf.queryExecution().toString()


def test_cold_start_reconciles_and_follows(spark, schema, empty, tmp_path):
    rows = source(spark, (1, "a", 5), (2, "a", 6))
    folder = f"file://{tmp_path}/events"
    spark.createDataFrame([(1, LATER, "src", 2, "update"), (2, NOW - timedelta(days=9), "src", 77, "delete")], streaming.EVENT).coalesce(1).write.parquet(folder)
    store = StateStore(spark, f"file://{tmp_path}/state", 4)
    q, controls = streaming.cold_start(streaming.change_stream(spark, folder), Sources(spark, {"src": lambda s: rows}), Registry(TASK), store, empty, f"file://{tmp_path}/check", lambda: LATER)
    q.awaitTermination(120)
    assert q.exception() is None and set(by_id(store.read(empty))) == {1, 2} and controls["t"].reconciled


# Stored state


def keyed(spark, schema, *keys, **fields):
    out = made(spark, schema, source_doc_id=keys[0], **fields)
    for k in keys[1:]:
        out = out.unionByName(made(spark, schema, source_doc_id=k, **fields))
    return out


def test_what_a_dead_writer_leaves_blocks_nobody(spark, schema, empty, tmp_path, monkeypatch):
    store = StateStore(spark, f"file://{tmp_path}/state", 4)
    store.write(keyed(spark, schema, 1, 2))

    def die(self, version):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(StateStore, "_publish", die)
        with pytest.raises(RuntimeError):
            store.write(keyed(spark, schema, 7))
    assert set(by_id(store.read(empty))) == {1, 2} and store.current().number == 1
    (tmp_path / "state" / "attempts").mkdir(exist_ok=True)
    (tmp_path / "state" / "attempts" / "half").write_text("{")
    assert store.write(keyed(spark, schema, 3)).number == 2 and set(by_id(store.read(empty))) == {3}
    store.write(keyed(spark, schema, 4))
    store.expire(1)
    assert len(store._names("data")) == 1 and set(by_id(store.read(empty))) == {4}


def test_two_writers_of_one_bucket_lose_nothing(spark, schema, empty, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/state", 1)
    store.write(keyed(spark, schema, 1, 2))
    base = store.current()
    mark = lambda key, error: lambda state, _=None: state.withColumn("last_error", F.when(F.col("source_doc_id") == key, error).otherwise(F.col("last_error")))
    store.write(mark(1, "first")(store.read(empty, [0], base)), None, [0], base)
    with pytest.raises(Conflict):
        store.write(mark(2, "second")(store.read(empty, [0], base)), None, [0], base)
    store.update(mark(2, "second"), empty, only=[0])
    assert {k: r.last_error for k, r in by_id(store.read(empty)).items()} == {1: "first", 2: "second"}

    def beside(state, version, done=[]):  # another writer comes between, once
        if not done:
            done.append(store.update(mark(1, "between"), empty, 5, [0], {"who": "other"}))
        return mark(2, "third")(state)

    assert store.update(beside, empty, only=[0]).batch == 5 and store.current().notes == {"who": "other"}
    assert {k: r.last_error for k, r in by_id(store.read(empty)).items()} == {1: "between", 2: "third"}


def test_writers_of_other_buckets_join(spark, schema, empty, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/state", 16)
    store.write(keyed(spark, schema, *range(12)))
    one, two = ([b] for b in store.buckets_of(store.read(empty))[:2])
    base = store.current()
    store.write(store.read(empty, one, base).withColumn("status", F.lit("completed")).withColumn("next_run_at", F.lit(None).cast("timestamp_ntz")), 3, one, base, {"a": 1})
    store.write(store.read(empty, two, base).withColumn("status", F.lit("failed")), None, two, base, {"b": 2})
    now = store.current()
    assert now.number == 3 and now.batch == 3 and now.notes == {"a": 1, "b": 2}
    rows = by_id(store.read(empty))
    completed = {k for k, r in rows.items() if r.status == "completed"}
    assert len(rows) == 12 and completed and any(r.status == "failed" for r in rows.values())
    assert {r.source_doc_id for r in store.due(LATER, 99).collect()} == set(rows) - completed
    with pytest.raises(Conflict):
        store.write(store.read(empty, at=base), base=base)
    assert store.note({"a": None}).notes == {"b": 2}


def test_a_worker_and_the_stream_on_one_bucket(spark, schema, empty, tmp_path):
    """While handlers run, the stream changes the same records: it isn't undone, and outcomes meet the changed rows."""
    prices = {1: 5, 2: 5}
    sources = Sources(spark, {"src": lambda s: source(s, *((k, "a", p) for k, p in prices.items()))})
    task = TaskDefinition("t", "src", "id", {"kind": "a"}, {"price": 1}, handler=lambda r: None)
    store = StateStore(spark, f"file://{tmp_path}/state", 1)
    store.write(keyed(spark, schema, 1, 2))
    worker = Worker(store, sources, Registry(task), empty, lambda: LATER)
    read, calls = store.read, []

    def reading(e, only=None, at=None):
        out = read(e, only, at)
        calls.append(at.number)
        if change := {1: 1, 3: 2}.get(len(calls)):  # between the claim's read and its write, and before the outcomes' write
            prices[change] += 1
            base = store.current()
            store.write(planner.plan(source(spark, (change, "a", prices[change])), [task], read(e, [0], base), LATER), None, [0], base)
        return out

    store.read = reading
    assert worker.round() == 1  # the first record has to wait again
    store.read = read
    rows = by_id(store.read(empty))
    assert {k: (r.observed.price, r.status, r.attempts) for k, r in rows.items()} == {1: (6, "pending", 0), 2: (6, "pending", 0)}
    assert len(rows[2].history) == 1 and {r.next_run_at for r in rows.values()} == {LATER + timedelta(seconds=1)} and store.current().number == 5


@pytest.mark.parametrize("buckets", [4, 32])
def test_a_claim_opens_few_files_whatever_the_buckets(spark, schema, empty, tmp_path, buckets):
    """The first of ten thousand records: nine thousand have no time, nine hundred come later, a hundred are due."""
    store = StateStore(spark, f"file://{tmp_path}/state", buckets, part=50, most=3)
    rest = [c for c in schema.fieldNames() if c not in ("source_doc_id", "next_run_at")]
    when = F.when(F.col("i") >= 9900, F.lit(NOW).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("i") - 9900).cast("decimal(18,6)"))).when(F.col("i") >= 9000, F.lit(NOW + timedelta(days=3)).cast("timestamp_ntz"))
    state = made(spark, schema).crossJoin(spark.range(10_000).select(F.col("id").alias("i"))).select(*rest, F.col("i").alias("source_doc_id"), when.alias("next_run_at")).select(schema.fieldNames())
    store.write(state)
    first = store.due(LATER, 1)
    assert [r.source_doc_id for r in first.collect()] == [9900] and len(first.inputFiles()) == 1
    for k in range(9900, 9908):  # the first ones are done, one by one
        only = store.buckets_of(spark.createDataFrame([(k,)], "source_doc_id long"))
        store.update(lambda s, _, k=k: s.withColumn("next_run_at", F.when(F.col("source_doc_id") != k, F.col("next_run_at"))), empty, only=only)
        first = store.due(LATER, 1)
        assert [r.source_doc_id for r in first.collect()] == [k + 1] and len(first.inputFiles()) <= 8
    assert [r.source_doc_id for r in store.due(LATER, 500).collect()] == list(range(9908, 10_000))
    assert store.due(NOW - timedelta(days=1), 5) is None and store.due(LATER, 5, ["other"]).count() == 0


def test_reconcile_goes_on_behind_its_checkpoint(spark, schema, empty, tmp_path):
    rows = spark.range(400).select("id", F.lit("a").alias("kind"), (F.col("id") % 7).cast("long").alias("price"))
    rows.repartitionByRange(8, "id").write.parquet(f"{tmp_path}/src.parquet")
    read = []

    def src(s):
        read.append(1)
        return s.read.parquet(f"{tmp_path}/src.parquet")

    sources = Sources(spark, {"src": src})
    start = keyed(spark, schema, 5, 900, updated_at=NOW - timedelta(days=1))
    store = StateStore(spark, f"file://{tmp_path}/state", 4)
    store.write(start)
    asked = iter([False, False, True])
    controls = reconcile.reconcile_checkpointed(sources, Registry(TASK), store, empty, LATER, 100, lambda: next(asked))
    place = store.current().notes["reconcile src"]
    assert not controls["t"].reconciled and place["tasks"] == ["t"] and 150 < place["last"] < 250
    assert set(by_id(store.read(empty))) == {*range(place["last"] + 1), 900}
    version = store.current().number

    killed = iter([False])
    with pytest.raises(StopIteration):  # dies behind one more range
        reconcile.reconcile_checkpointed(sources, Registry(TASK), store, empty, LATER, 100, lambda: next(killed))
    assert store.current().notes["reconcile src"]["last"] > place["last"]
    controls = reconcile.reconcile_checkpointed(sources, Registry(TASK), store, empty, LATER, 100)
    assert controls["t"].reconciled and "reconcile src" not in store.current().notes and store.current().number > version
    whole, _ = reconcile.reconcile(sources, Registry(TASK), {}, start, LATER)
    assert by_id(store.read(empty)) == by_id(whole) and 900 not in by_id(whole)
    n, again = store.current().number, len(read)
    assert reconcile.reconcile_checkpointed(sources, Registry(TASK), store, empty, LATER, 100) == controls
    assert (store.current().number, len(read)) == (n, again)  # nothing to do, nothing read

    other = TaskDefinition("u", "src", "id", {"kind": "a"}, {"price": 1}, evolution=Evolution())
    store.note({"reconcile src": {"tasks": ["t"], "last": 399}})  # made for other tasks: from the start
    reconcile.reconcile_checkpointed(sources, Registry(TASK, other), store, empty, LATER, 1000)
    assert store.read(empty).filter("task = 'u'").count() == 400


def test_an_upgrade_is_reset_once_however_often_a_reconcile_is_stopped(spark, schema, empty, tmp_path):
    v2 = TaskDefinition("t", "src", "id", {"kind": "a"}, {"price": 1}, evolution=Evolution(version=2, on_upgrade="reprocess_all"))
    sources = Sources(spark, {"src": lambda s: source(s, (1, "a", 5))})
    store = StateStore(spark, f"file://{tmp_path}/state", 2)
    store.write(keyed(spark, schema, 1, status="completed", next_run_at=None), notes={"controls": {"t": reconcile._note(reconcile.Control(v2.signature(), 1, False))}})
    reconcile.reconcile_checkpointed(sources, Registry(v2), store, empty, LATER, should_stop=lambda: True)
    assert by_id(store.read(empty))[1].status == "pending"
    store.update(lambda s, _: s.withColumn("status", F.lit("completed")), empty)
    reconcile.reconcile_checkpointed(sources, Registry(v2), store, empty, LATER)
    assert by_id(store.read(empty))[1].status == "completed" and reconcile.noted_controls(store.current())["t"].version == 2


def test_outcomes_scan_each_source_once(spark, schema, tmp_path):
    source(spark, (1, "a", 5), (2, "b", 6), (3, "a", 9)).write.parquet(f"{tmp_path}/src.parquet")
    sources = Sources.of_parquet(spark, str(tmp_path), ["src"])
    task = TaskDefinition("t", "src", "id", {"kind": "a"}, {"price": 1}, handler=lambda r: None)
    claimed = keyed(spark, schema, 1, 2, 3, 4)
    said = outcomes(claimed, sources, Registry(task), NOW, ranges=key_ranges(claimed, Registry(task)))
    plan = said._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "LessThanOrEqual(id,4)" in plan
    assert {r.source_doc_id: r.outcome for r in said.collect()} == {1: "completed", 2: "skipped", 3: "skipped", 4: "skipped"}


def test_debounce_of_a_live_stream_expires_its_state(spark, tmp_path):
    at = lambda s: NOW + timedelta(seconds=s)
    batches = [[(1, at(0), "s", 1, "insert"), (2, at(5), "s", 1, "update")], [(3, at(12), "s", 1, "update"), (4, at(14), "s", 2, "update")], [(5, at(60), "s", 1, "update")], [(6, at(500), "beat", 0, "update")]]
    folder = f"file://{tmp_path}/events"
    for b in batches:
        spark.createDataFrame(b, streaming.EVENT).coalesce(1).write.mode("append").parquet(folder)
    live = streaming.debounced_stream(streaming.change_stream(spark, folder), "10 seconds", "source", "key")
    q = live.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None and len({p["batchId"] for p in q.recentProgress}) >= 4
    got = sorted((r.source, r.key, r.run_at, r.events) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("s", 1, at(22), 3), ("s", 1, at(70), 1), ("s", 2, at(24), 1)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # the heartbeat's own


def run_log(spark, folder, store, rows, empty, check, clock, *batches, registry=None, **options):
    """Append each batch as a file of the log, then run the stream to its end."""
    for b in batches:
        spark.createDataFrame(b, streaming.EVENT).coalesce(1).write.mode("append").parquet(folder)
    q = streaming.start(streaming.change_stream(spark, folder), Sources(spark, {"src": lambda s: rows}), registry or Registry(TASK), store, empty, check, clock, **options)
    q.awaitTermination(180)
    assert q.exception() is None
    return store.current().notes


def test_the_token_finds_lost_events_and_skips_known_ones(spark, schema, empty, tmp_path):
    rows = source(spark, *((i, "a", i) for i in range(8)))
    event = lambda n, key: (n, NOW, "src", key, "update")
    folder, store = f"file://{tmp_path}/log", StateStore(spark, f"file://{tmp_path}/state", 2)
    store.write(empty)
    run = lambda check, *batches: run_log(spark, folder, store, rows, empty, f"file://{tmp_path}/{check}", lambda: LATER, *batches, sequenced=True)
    assert run("one", [event(1, 0), event(2, 1)], [event(3, 2)])["token"] == 3 and set(by_id(store.read(empty))) == {0, 1, 2}
    assert run("one", [event(3, 2), event(4, 3)])["token"] == 4 and set(by_id(store.read(empty))) == {0, 1, 2, 3}  # an overlap
    n = store.current().number
    store.update(lambda s, _: s.withColumn("status", F.lit("completed")), empty, batch=-1)
    notes = run("other")  # another checkpoint: the whole log again, but nothing is behind the token
    assert notes["token"] == 4 and "lost" not in notes and store.current().number == n + 1
    assert {r.status for r in store.read(empty).collect()} == {"completed"}
    notes = run("other", [event(7, 7)])  # 5 and 6 are gone
    assert (notes["token"], notes["lost"]) == (7, 2) and set(by_id(store.read(empty))) == set(range(8))
    assert reconcile.noted_controls(store.current())["t"].reconciled and reconcile.noted_controls(store.current())["t"].last_reconciled_at == LATER


def test_the_stream_cleans_up_on_its_own_schedule(spark, schema, empty, tmp_path):
    rows = source(spark, (1, "a", 5))
    folder, check = f"file://{tmp_path}/log", f"file://{tmp_path}/check"
    store = StateStore(spark, f"file://{tmp_path}/state", 4)
    store.write(keyed(spark, schema, 50, 51, updated_at=NOW - timedelta(days=1)))
    at = [LATER]
    run = lambda *b: run_log(spark, folder, store, rows, empty, check, lambda: at[0], *b, cleanup_ms=3_600_000)
    assert run([(1, NOW, "src", 1, "insert")])["cleanups"] == 1 and set(by_id(store.read(empty))) == {1}
    store.update(lambda s, _: s.unionByName(keyed(spark, schema, 52, updated_at=NOW - timedelta(days=1))), empty)
    at[0] = LATER + timedelta(minutes=59)
    assert run([(2, NOW, "src", 1, "update")])["cleanups"] == 1 and set(by_id(store.read(empty))) == {1, 52}
    at[0] = LATER + timedelta(minutes=60)
    assert run([(3, NOW, "src", 1, "update")])["cleanups"] == 2 and set(by_id(store.read(empty))) == {1}


def test_a_log_is_followed_by_its_numbers(spark, schema, empty, tmp_path):
    rows = source(spark, *((i, "a", i) for i in range(12)))
    spark.createDataFrame([(i, NOW, "src", i, "update") for i in range(3, 10)], streaming.EVENT).coalesce(1).write.parquet(f"{tmp_path}/log")
    log = lambda: spark.read.parquet(f"{tmp_path}/log")
    sources, registry = Sources(spark, {"src": lambda s: rows}), Registry(TASK)
    store = StateStore(spark, f"file://{tmp_path}/state", 2)
    store.write(empty)
    run = lambda **options: streaming.follow(log(), sources, registry, store, empty, lambda: LATER, **{"per_batch": 2} | options)
    assert run(batches=1) == 1 and set(by_id(store.read(empty))) == {3, 4} and store.current().notes["token"] == 4
    update, calls = store.update, []

    def dying(*args, **options):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        return update(*args, **options)

    store.update = dying
    with pytest.raises(RuntimeError):
        run()
    store.update = update
    assert store.current().notes["token"] == 6 and set(by_id(store.read(empty))) == {3, 4, 5, 6}
    assert run() == 2 and run() == 0 and set(by_id(store.read(empty))) == set(range(3, 10)) and "lost" not in store.current().notes
    spark.createDataFrame([(20, NOW, "src", 11, "update")], streaming.EVENT).write.mode("append").parquet(f"{tmp_path}/log")
    assert run() == 1 and store.current().notes["lost"] == 10 and set(by_id(store.read(empty))) == set(range(12))
    other = StateStore(spark, f"file://{tmp_path}/other", 2)
    other.write(empty)
    assert streaming.follow(log(), sources, registry, other, empty, lambda: LATER, after=8, batches=1, per_batch=1) == 1 and set(by_id(other.read(empty))) == {9}
