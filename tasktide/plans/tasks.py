"""Queries over planning, records, schedules, metrics and change events."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import Filters
from ..functions.projection import watched
from ..model import Registry, RetryPolicy
from ..operators import cleanup, cron, listing, metrics, planner, reconcile, transitions, worker
from ..operators.handlers import Defer, Throttle, run_handlers, with_source_row
from .. import streaming
from ..sources import Sources
from .registry import query
from .sample_state import NOW, OPEN, REGISTRY, SQL_EXECUTIONS, SQL_JOBS, SQL_NOW, SQL_RECORDS, URGENT, change_events, executions, jobs, records, table

KEYS = ["task", "source_doc_id"]
TASKS = [OPEN, URGENT]
_PLANNED = """planned AS (
  SELECT 'open_orders' AS task, o_orderkey AS source_doc_id, o_totalprice AS observed, 1000 AS debounce_ms FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'urgent_orders', o_orderkey, o_totalprice, 5000 FROM orders WHERE o_orderpriority = '1-URGENT')"""
def _both(old, new):
    """A full join of records and planned rows, in SQL."""
    return (
        "both_ AS (SELECT coalesce(r.task, p.task) AS task, coalesce(r.source_doc_id, p.source_doc_id) AS source_doc_id, r.status, r.attempts, r.due_at, r.next_run_at, r.updated_at, r.last_error, r.observed AS old, p.observed AS new, p.debounce_ms, "
        "r.task IS NULL AS inserted, p.task IS NOT NULL AND r.task IS NOT NULL AND r.observed <> p.observed AS changed, p.task IS NOT NULL AS planned "
        f"FROM {old} r FULL JOIN {new} p ON r.task = p.task AND r.source_doc_id = p.source_doc_id)"
    )


_SQL = f"WITH {SQL_RECORDS}, {_PLANNED}, {_both('records', 'planned')} "
#: The columns of a state after planning, from both_ and from records alone.
_MERGED = f"""task, source_doc_id,
  CASE WHEN inserted THEN 'pending' WHEN changed AND status IN ('processing', 'processing_dirty') THEN 'processing_dirty' WHEN changed THEN 'pending' ELSE status END AS status,
  CASE WHEN inserted OR changed THEN 0 ELSE attempts END AS attempts,
  CAST(epoch_ms(CASE WHEN inserted OR changed THEN {SQL_NOW} + debounce_ms * INTERVAL 1 MILLISECOND ELSE due_at END) AS BIGINT) AS due_ms,
  CAST(epoch_ms(CASE WHEN inserted OR (changed AND status NOT IN ('processing', 'processing_dirty')) THEN {SQL_NOW} + debounce_ms * INTERVAL 1 MILLISECOND ELSE next_run_at END) AS BIGINT) AS next_ms,
  CAST(epoch_ms(CASE WHEN inserted OR changed THEN {SQL_NOW} ELSE updated_at END) AS BIGINT) AS updated_ms,
  CASE WHEN inserted OR changed THEN NULL ELSE last_error END AS last_error,
  CAST(CASE WHEN planned THEN new ELSE old END AS DECIMAL(18,2)) AS observed"""
_STORED = "task, source_doc_id, status, attempts, CAST(epoch_ms(due_at) AS BIGINT) AS due_ms, CAST(epoch_ms(next_run_at) AS BIGINT) AS next_ms, CAST(epoch_ms(updated_at) AS BIGINT) AS updated_ms, last_error, CAST(observed AS DECIMAL(18,2)) AS observed"


def _epoch(c):
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c) if isinstance(c, str) else c)


def _rows(s):
    return s.select(*KEYS, "status", "attempts", _epoch("due_at").alias("due_ms"), _epoch("next_run_at").alias("next_ms"), _epoch("updated_at").alias("updated_ms"), "last_error", F.col("observed.o_totalprice").cast("decimal(18,2)").alias("observed"))


# Planning


@query(f"WITH {_PLANNED} SELECT task, source_doc_id, CAST(observed AS DECIMAL(18,2)) AS observed, CAST(debounce_ms AS BIGINT) AS debounce_ms FROM planned")
def plan_fanout(spark, sf_dir):
    """All tasks of a source from one scan."""
    return planner.fan_out(table(spark, sf_dir, "orders"), TASKS, NOW).select(*KEYS, F.col("observed.o_totalprice").cast("decimal(18,2)").alias("observed"), "debounce_ms")


@query(f"WITH {_PLANNED} SELECT task, count(*) AS n, CAST(epoch_ms(min({SQL_NOW} + debounce_ms * INTERVAL 1 MILLISECOND)) AS BIGINT) AS due_ms, 'pending' AS status, 0 AS attempts FROM planned GROUP BY task")
def plan_insert_rows(spark, sf_dir):
    """New records are pending and due after their debounce."""
    new = planner.planned(table(spark, sf_dir, "orders"), TASKS, NOW)
    return new.groupBy("task").agg(F.count("*").alias("n"), F.min(_epoch("due_at")).alias("due_ms"), F.max("status").alias("status"), F.max("attempts").alias("attempts"))


@query(_SQL + "SELECT task, CASE WHEN inserted THEN 'insert' WHEN NOT planned THEN 'untouched' WHEN changed THEN 'changed' ELSE 'noop' END AS action, count(*) AS n FROM both_ GROUP BY ALL")
def plan_merge_actions(spark, sf_dir):
    """The flagship: what a full plan over orders does to the stored records."""
    new = planner.planned(table(spark, sf_dir, "orders"), TASKS, NOW)
    return planner.actions(records(spark, sf_dir), new).groupBy("task", "action").agg(F.count("*").alias("n"))


@query(_SQL + f"SELECT {_MERGED} FROM both_")
def plan_merge_state(spark, sf_dir):
    """The whole state after a plan."""
    return _rows(planner.plan(table(spark, sf_dir, "orders"), TASKS, records(spark, sf_dir), NOW))


@query("SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * l_quantity AS DECIMAL(18,2)) AS total, l_returnflag AS flag FROM lineitem")
def plan_computed_watch(spark, sf_dir):
    """A computed and a nested watch field."""
    rows = table(spark, sf_dir, "lineitem")
    w = watched(Filters(rows.schema, NOW), {"total": {"$multiply": ["$l_extendedprice", "$l_quantity"]}, "l_returnflag": 1}, rows.schema)
    return rows.select("l_orderkey", "l_linenumber", w.alias("w")).select("l_orderkey", "l_linenumber", F.col("w.total").cast("decimal(18,2)").alias("total"), F.col("w.l_returnflag").alias("flag"))


@query("WITH i AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE 0 END) AS s, max(l_linenumber) AS m FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(s AS DOUBLE) AS active, m > 3 AS high FROM i")
def plan_watch_arrays(spark, sf_dir):
    """A fold and a maximum over an array of structs."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_returnflag") == "N").alias("active"), F.col("l_linenumber").alias("val"))).alias("items"))
    fold = {"$reduce": {"input": "$items", "initialValue": 0.0, "in": {"$add": ["$$value", {"$cond": ["$$this.active", {"$multiply": ["$$this.val", 1.0]}, 0.0]}]}}}
    high = {"$gt": [{"$max": "$items.val"}, 3]}
    w = watched(Filters(rows.schema), {"active": fold, "high": high}, rows.schema)
    return rows.select("l_orderkey", w.alias("w")).select("l_orderkey", "w.active", "w.high")


@query(_SQL + "SELECT count(*) AS n FROM both_ WHERE changed")
def plan_is_idempotent(spark, sf_dir):
    """Changes of a plan; planning its result again changes nothing, which is subtracted here."""
    orders, state = table(spark, sf_dir, "orders"), records(spark, sf_dir)
    new = planner.planned(orders, TASKS, NOW)
    once, twice = planner.actions(state, new), planner.actions(planner.merge(state, new), new)
    changed = lambda a, s: a.filter("action = 'changed'").select(F.lit(s).alias("s"))
    return changed(once, 1).unionByName(changed(twice, -1)).agg(F.count_if(F.col("s") == 1).alias("a"), F.count_if(F.col("s") == -1).alias("b")).select((F.col("a") - F.col("b")).alias("n"))


# Lists and statistics

_LIST = "task, source_doc_id, status, attempts"


@query(f"WITH {SQL_RECORDS} SELECT {_LIST} FROM records ORDER BY next_run_at ASC NULLS LAST, task, source_doc_id LIMIT 50 OFFSET 20")
def task_list_page(spark, sf_dir):
    """A page of the list, in a total order."""
    return listing.page(records(spark, sf_dir), limit=50, offset=20).select(*_LIST.split(", "))


@query(f"WITH {SQL_RECORDS}, u AS (SELECT {_LIST}, next_run_at FROM records UNION ALL SELECT 'customers', c_custkey, 'pending', 0, TIMESTAMP '1995-06-01' + (c_custkey % 900) * INTERVAL 1 HOUR FROM customer) SELECT {_LIST} FROM u ORDER BY next_run_at ASC NULLS LAST, task, source_doc_id LIMIT 50")
def task_list_multi_source(spark, sf_dir):
    """One list over the records of two sources: a global top-k."""
    hours = F.make_dt_interval(F.lit(0), (F.col("c_custkey") % 900).cast("int"))
    other = table(spark, sf_dir, "customer").select(F.lit("customers").alias("task"), F.col("c_custkey").alias("source_doc_id"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), (F.lit("1995-06-01 00:00:00").cast("timestamp_ntz") + hours).alias("next_run_at"))
    return listing.page(listing.union([records(spark, sf_dir), other])).select(*_LIST.split(", "))


@query(f"WITH {SQL_RECORDS} SELECT source_doc_id, attempts FROM records WHERE task = 'open_orders' AND status IN ('pending', 'failed') AND last_error IS NOT NULL AND regexp_matches(last_error, 'rate|time', 'i')")
def task_list_query(spark, sf_dir):
    """All conditions of a task query at once."""
    q = listing.TaskQuery(task="open_orders", status="pending, failed", error="RATE|time", has_error=True)
    return listing.matching(records(spark, sf_dir), q).select("source_doc_id", "attempts")


@query(f"WITH {SQL_RECORDS} SELECT source_doc_id, r.status FROM records r WHERE source_doc_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)")
def task_list_by_source(spark, sf_dir):
    """A filter on rows of the source: a semi join."""
    q = listing.TaskQuery(source_filter={"o_totalprice": {"$gt": 300000}})
    return listing.matching(records(spark, sf_dir), q, table(spark, sf_dir, "orders"), "o_orderkey").select("source_doc_id", "status")


@query(f"WITH {SQL_RECORDS} SELECT count(*) AS total FROM records WHERE status = 'pending'")
def task_count(spark, sf_dir):
    return listing.matching(records(spark, sf_dir), listing.TaskQuery(status="pending")).agg(F.count("*").alias("total"))


@query(f"WITH {SQL_RECORDS} SELECT source_doc_id, status FROM records WHERE source_doc_id = 32")
def smart_id_lookup(spark, sf_dir):
    """An id typed as text."""
    return listing.by_smart_id(records(spark, sf_dir), " 32").select("source_doc_id", "status")


@query(f"WITH {SQL_RECORDS} SELECT status, count(*) AS n FROM records GROUP BY 1")
def stats_status(spark, sf_dir):
    return listing.status_counts(records(spark, sf_dir))


@query(f"WITH {SQL_RECORDS} SELECT task, status, count(*) AS n FROM records GROUP BY ALL")
def stats_by_task(spark, sf_dir):
    return listing.status_counts(records(spark, sf_dir), by_task=True)


@query(f"WITH {SQL_RECORDS} SELECT task, count(last_error) AS errors FROM records GROUP BY 1")
def stats_errors(spark, sf_dir):
    return listing.error_counts(records(spark, sf_dir), by_task=True)


@query(
    f"WITH {SQL_RECORDS} SELECT CASE grouping_id(task, status) WHEN 0 THEN 'task_status' WHEN 1 THEN 'task' ELSE 'all' END AS level, task, status, count(*) AS n, count(last_error) AS errors, "
    "CAST(epoch_ms(min(CASE WHEN status = 'pending' THEN due_at END)) AS BIGINT) AS first_due_ms FROM records GROUP BY GROUPING SETS ((task, status), (task), ())"
)
def stats_facet(spark, sf_dir):
    """All statistics in one scan."""
    f = listing.facet(records(spark, sf_dir))
    return f.select("level", "task", "status", "n", "errors", _epoch("first_due").alias("first_due_ms"))


@query(
    f"WITH {SQL_RECORDS} SELECT task, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'processing_dirty') AS processing_dirty, "
    "count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(last_error) AS errors FROM records GROUP BY task"
)
def stats_per_task(spark, sf_dir):
    return listing.per_task(records(spark, sf_dir)).drop("first_due")


@query(
    f"WITH {SQL_RECORDS}, d(task, source) AS (VALUES ('open_orders', 'orders'), ('urgent_orders', 'orders')), c AS (SELECT task, count(*) FILTER (status = 'completed') AS success, count(*) FILTER (status = 'failed') AS failed, "
    "count(*) FILTER (status IN ('processing', 'processing_dirty')) AS processing, count(*) FILTER (status = 'pending') AS pending, count(last_error) AS error FROM records GROUP BY task) "
    "SELECT d.task, source, coalesce(success, 0) AS success, coalesce(failed, 0) AS failed, coalesce(processing, 0) AS processing, coalesce(pending, 0) AS pending, coalesce(error, 0) AS error FROM d LEFT JOIN c ON d.task = c.task ORDER BY d.task"
)
def stats_info_buckets(spark, sf_dir):
    """Counts for each defined task, zero where there are none."""
    return listing.info(records(spark, sf_dir), REGISTRY)


@query(f"WITH {SQL_RECORDS} SELECT status, count(*) AS n FROM records WHERE task = 'urgent_orders' GROUP BY 1")
def task_overview(spark, sf_dir):
    """The status counts beside a filtered list: its status and error conditions don't apply to them."""
    return listing.overview(records(spark, sf_dir), listing.TaskQuery(task="urgent_orders", status="failed", has_error=True))[2]


@query(
    f"WITH {SQL_RECORDS}, h AS (SELECT *, last_error IS NOT NULL AND regexp_matches(last_error, 'rate', 'i') AND source_doc_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) AS hit FROM records) "
    "SELECT task, CASE WHEN hit AND status IN ('processing', 'processing_dirty') THEN 'processing_dirty' WHEN hit THEN 'pending' ELSE status END AS status, count(*) AS n FROM h GROUP BY 1, 2"
)
def retry_by_query(spark, sf_dir):
    """A retry of all tasks' records by their error and by their source rows."""
    q = listing.TaskQuery(error="RATE", source_filter={"o_totalprice": {"$gt": 100000}})
    return listing.retry(records(spark, sf_dir), REGISTRY, q, NOW, lambda name: table(spark, sf_dir, name)).groupBy("task", "status").agg(F.count("*").alias("n"))


# Transitions


@query(f"WITH {SQL_RECORDS} SELECT task, source_doc_id FROM records WHERE next_run_at <= {SQL_NOW} ORDER BY next_run_at, task, source_doc_id LIMIT 50")
def claim_due_topk(spark, sf_dir):
    """The first due records."""
    return transitions.due(records(spark, sf_dir), NOW, 50).select(*KEYS)


@query(
    f"WITH {SQL_RECORDS}, d AS (SELECT task AS t, source_doc_id AS i FROM records WHERE next_run_at <= {SQL_NOW} ORDER BY next_run_at, task, source_doc_id LIMIT 100) "
    f"SELECT CASE WHEN t IS NULL THEN status ELSE 'processing' END AS status, CASE WHEN t IS NULL THEN attempts ELSE attempts + 1 END AS attempts, count(*) AS n, max(CAST(epoch_ms(CASE WHEN t IS NOT NULL THEN {SQL_NOW} + INTERVAL 1 MINUTE END) AS BIGINT)) AS lock_ms "
    "FROM records LEFT JOIN d ON task = t AND source_doc_id = i GROUP BY 1, 2"
)
def claim_state(spark, sf_dir):
    """The state after a claim of a hundred."""
    s = transitions.claim(records(spark, sf_dir), NOW, 100)
    return s.groupBy("status", "attempts").agg(F.count("*").alias("n"), F.max(F.when(F.col("started_at").isNotNull(), _epoch("next_run_at"))).alias("lock_ms"))


def _outcomes(spark, sf_dir, outcome):
    busy = records(spark, sf_dir).filter("status in ('processing', 'processing_dirty')")
    until = F.lit(NOW + timedelta(hours=1)).cast("timestamp_ntz")
    return busy.select(*KEYS, F.lit(outcome).alias("outcome"), (F.col("source_doc_id") % 100).alias("duration_ms"), F.when(F.lit(outcome == "failed"), "broken").alias("error"), F.when(F.lit(outcome == "deferred"), until).alias("until"))


def _final(s):
    return s.select(*KEYS, "status", "attempts", _epoch("next_run_at").alias("next_ms"), "last_error", _epoch("first_error_at").alias("first_error_ms"), _epoch("last_finalized_at").alias("finalized_ms"), F.coalesce(F.size("history"), F.lit(0)).alias("runs"))


def _final_sql(status, next_run, attempts="attempts", error="NULL", first="NULL", done=True):
    """What becomes of records in status processing; the rest of the state is fixed."""
    now, runs = f"CAST(epoch_ms({SQL_NOW}) AS BIGINT)", "1" if done else "0"
    dirty = (
        ("'pending'", "epoch_ms(updated_at + INTERVAL 1 SECOND)", "attempts", "last_error", "epoch_ms(first_error_at)", now, "1") if done else (status, next_run, attempts, "last_error", "epoch_ms(first_error_at)", "NULL", "0")
    )
    other = ("status", "epoch_ms(next_run_at)", "attempts", "last_error", "epoch_ms(first_error_at)", "CASE WHEN status IN ('completed', 'failed') THEN epoch_ms(due_at) END", "CASE WHEN status IN ('completed', 'failed') THEN 1 ELSE 0 END")
    clean = (status, next_run, attempts, error if done else "last_error", first if done else "epoch_ms(first_error_at)", now if done else "NULL", runs)
    names = (("status", "VARCHAR"), ("attempts", "INTEGER"), ("next_ms", "BIGINT"), ("last_error", "VARCHAR"), ("first_error_ms", "BIGINT"), ("finalized_ms", "BIGINT"), ("runs", "INTEGER"))
    order = (0, 2, 1, 3, 4, 5, 6)
    columns = ", ".join(f"CAST(CASE status WHEN 'processing' THEN {clean[i]} WHEN 'processing_dirty' THEN {dirty[i]} ELSE {other[i]} END AS {t}) AS {n}" for i, (n, t) in zip(order, names, strict=True))
    return f"WITH {SQL_RECORDS} SELECT task, source_doc_id, {columns} FROM records"


_NOW_MS = f"epoch_ms({SQL_NOW})"


@query(_final_sql("'completed'", "NULL"))
def finalize_success(spark, sf_dir):
    """Successes complete; records that turned dirty are pending again."""
    return _final(transitions.finalize(records(spark, sf_dir), _outcomes(spark, sf_dir, "completed"), NOW, RetryPolicy()))


@query(_final_sql("'completed'", "NULL"))
def finalize_skipped(spark, sf_dir):
    """Skipped runs count as successes."""
    return _final(transitions.finalize(records(spark, sf_dir), _outcomes(spark, sf_dir, "skipped"), NOW, RetryPolicy()))


@query(_final_sql("CASE WHEN attempts >= 4 THEN 'failed' ELSE 'pending' END", f"CASE WHEN attempts < 4 THEN {_NOW_MS} + CAST(least(10000, 1000 * pow(2, greatest(attempts, 1) - 1)) AS BIGINT) END", error="'broken'", first=_NOW_MS))
def finalize_retry_exponential(spark, sf_dir):
    """Failures are tried again after a growing time, or given up."""
    policy = RetryPolicy("exponential", min="1s", max="10s", factor=2, max_attempts=4)
    return _final(transitions.finalize(records(spark, sf_dir), _outcomes(spark, sf_dir, "failed"), NOW, policy))


@query(_final_sql("'pending'", f"{_NOW_MS} + CASE greatest(attempts, 1) WHEN 1 THEN 1000 WHEN 2 THEN 10000 ELSE 60000 END", error="'broken'", first=_NOW_MS))
def finalize_retry_series(spark, sf_dir):
    policy = RetryPolicy("series", intervals=("1s", "10s", "1m"), max_attempts=-1)
    return _final(transitions.finalize(records(spark, sf_dir), _outcomes(spark, sf_dir, "failed"), NOW, policy))


@query(_final_sql("'pending'", f"{_NOW_MS} + 60000 * greatest(attempts, 1)", error="'broken'", first=_NOW_MS))
def finalize_retry_linear(spark, sf_dir):
    return _final(transitions.finalize(records(spark, sf_dir), _outcomes(spark, sf_dir, "failed"), NOW, RetryPolicy("linear", interval="1m", max_attempts=-1)))


@query(_final_sql("'pending'", f"{_NOW_MS} + 43200000", error="'broken'", first=_NOW_MS))
def finalize_retry_cron(spark, sf_dir):
    return _final(transitions.finalize(records(spark, sf_dir), _outcomes(spark, sf_dir, "failed"), NOW, RetryPolicy("cron", expression="0 12 * * *", max_attempts=-1)))


@query(_final_sql("CASE WHEN attempts >= 1 THEN 'failed' ELSE 'pending' END", f"CASE WHEN attempts < 1 THEN {_NOW_MS} + 5000 END", error="'broken'", first=_NOW_MS))
def finalize_give_up(spark, sf_dir):
    return _final(transitions.finalize(records(spark, sf_dir), _outcomes(spark, sf_dir, "failed"), NOW, RetryPolicy("fixed", interval="5s", max_attempts=1)))


@query(_final_sql("'pending'", f"{_NOW_MS} + 3600000", attempts="0", done=False))
def defer_tasks(spark, sf_dir):
    """Deferred runs wait until the given time, attempts forgotten."""
    return _final(transitions.finalize(records(spark, sf_dir), _outcomes(spark, sf_dir, "deferred"), NOW, RetryPolicy()))


@query(
    f"WITH {SQL_RECORDS}, h AS (SELECT *, task = 'urgent_orders' AND status <> 'completed' AS hit, status IN ('processing', 'processing_dirty') AS busy FROM records) "
    f"SELECT task, CASE WHEN hit AND busy THEN 'processing_dirty' WHEN hit THEN 'pending' ELSE status END AS status, attempts, count(*) AS n, count(*) FILTER (hit AND NOT busy) AS now_due FROM h GROUP BY 1, 2, 3"
)
def reset_tasks(spark, sf_dir):
    """A reset by hand keeps attempts, and locks of busy records."""
    s = transitions.reset(records(spark, sf_dir), (F.col("task") == "urgent_orders") & (F.col("status") != "completed"), NOW)
    due_now = (F.col("next_run_at") == F.lit(NOW).cast("timestamp_ntz")) & (F.col("updated_at") == F.lit(NOW).cast("timestamp_ntz"))
    return s.groupBy("task", "status", "attempts").agg(F.count("*").alias("n"), F.count_if(due_now).alias("now_due"))


@query(
    f"WITH {SQL_RECORDS}, h AS (SELECT *, task = 'open_orders' AND source_doc_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 50000) AS hit FROM records) "
    "SELECT CASE WHEN hit AND status IN ('processing', 'processing_dirty') THEN 'processing_dirty' WHEN hit THEN 'pending' ELSE status END AS status, count(*) AS n FROM h GROUP BY 1"
)
def retry_by_source_filter(spark, sf_dir):
    """Retry the records of source rows that match a filter."""
    o = table(spark, sf_dir, "orders")
    keys = o.filter(Filters(o.schema).where({"o_totalprice": {"$lt": 50000}})).select(F.col("o_orderkey").alias("source_doc_id"))
    return transitions.retry_by_source(records(spark, sf_dir), keys, F.col("task") == "open_orders", NOW).groupBy("status").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, list(event_id ORDER BY ts, event_id)::VARCHAR AS kept FROM n WHERE k <= 5 GROUP BY user_id")
def history_last_n(spark, sf_dir):
    """The last five entries of a history."""
    newest = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", newest.alias("k")).filter(F.col("k") <= 5)
    runs = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("h"))
    kept = F.transform("h", lambda x: x["event_id"].cast("string"))
    return runs.select("user_id", F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]")).alias("kept"))


_CURRENT = f"WITH {SQL_RECORDS}, {_PLANNED}, due_ AS (SELECT * FROM records WHERE next_run_at <= {SQL_NOW})"


@query(_CURRENT + "SELECT task, source_doc_id FROM due_ d WHERE EXISTS (SELECT 1 FROM planned p WHERE p.task = d.task AND p.source_doc_id = d.source_doc_id AND p.observed = d.observed)")
def late_binding_valid(spark, sf_dir):
    """Due records whose row still matches and is unchanged."""
    return transitions.still_valid(records(spark, sf_dir).filter(transitions.is_due(NOW)), planner.fan_out(table(spark, sf_dir, "orders"), TASKS, NOW)).select(*KEYS)


@query(_CURRENT + "SELECT task, source_doc_id FROM due_ d WHERE NOT EXISTS (SELECT 1 FROM planned p WHERE p.task = d.task AND p.source_doc_id = d.source_doc_id AND p.observed = d.observed)")
def late_binding_skipped(spark, sf_dir):
    return transitions.no_longer_valid(records(spark, sf_dir).filter(transitions.is_due(NOW)), planner.fan_out(table(spark, sf_dir, "orders"), TASKS, NOW)).select(*KEYS)


# Cleanup and evolution

_HAS_LINES = "SELECT l_orderkey FROM lineitem"


def _live(spark, sf_dir):
    """Orders with lines, as the source of which the others are gone."""
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query(f"WITH {SQL_RECORDS} SELECT source_doc_id FROM records WHERE task = 'open_orders' AND updated_at < {SQL_NOW} AND source_doc_id NOT IN ({_HAS_LINES})")
def orphans_deleted(spark, sf_dir):
    """Records whose source row is gone."""
    return cleanup.orphans(records(spark, sf_dir), _live(spark, sf_dir), OPEN, NOW).select("source_doc_id")


@query(f"WITH {SQL_RECORDS} SELECT source_doc_id FROM records WHERE task = 'urgent_orders' AND updated_at < {SQL_NOW} AND source_doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey IN ({_HAS_LINES}))")
def orphans_not_matching(spark, sf_dir):
    """Gone, or no longer matching the filter."""
    return cleanup.orphans(records(spark, sf_dir), _live(spark, sf_dir), URGENT, NOW).select("source_doc_id")


@query(f"WITH {SQL_RECORDS} SELECT task, count(*) AS n FROM records WHERE updated_at < {SQL_NOW} - INTERVAL 900 DAY GROUP BY 1")
def retention_cutoff(spark, sf_dir):
    return records(spark, sf_dir).filter(cleanup.expired(NOW, 900 * 86_400_000)).groupBy("task").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_RECORDS} SELECT {_STORED} FROM records WHERE NOT (task = 'open_orders' AND updated_at < {SQL_NOW} AND source_doc_id NOT IN ({_HAS_LINES}))")
def cleanup_state(spark, sf_dir):
    """The state without a task's orphans."""
    return _rows(cleanup.clean(records(spark, sf_dir), _live(spark, sf_dir), OPEN, NOW))


@query(f"WITH {SQL_RECORDS} SELECT source_doc_id FROM records WHERE task = 'open_orders' AND updated_at < {SQL_NOW} AND source_doc_id NOT IN ({_HAS_LINES}) AND source_doc_id IN (SELECT event_id FROM events WHERE event_type <> 'click')")
def cleanup_after_deletes(spark, sf_dir):
    """Immediate cleanup, limited to rows that delete events name (here: the numbers of all events but clicks)."""
    gone = table(spark, sf_dir, "events").filter("event_type <> 'click'").select(F.col("event_id").alias("source_doc_id"))
    return cleanup.orphans(records(spark, sf_dir), _live(spark, sf_dir), OPEN, NOW, only=gone).select("source_doc_id")


@query(
    f"WITH {SQL_RECORDS} SELECT {_STORED} FROM records WHERE NOT (updated_at < {SQL_NOW} AND CASE WHEN task = 'open_orders' THEN source_doc_id NOT IN ({_HAS_LINES}) "
    f"ELSE source_doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey IN ({_HAS_LINES})) END)"
)
def cleanup_all(spark, sf_dir):
    """The periodic cleanup of all tasks."""
    return _rows(cleanup.clean_all(records(spark, sf_dir), lambda name: _live(spark, sf_dir), REGISTRY, NOW))


@query(f"WITH {SQL_RECORDS} SELECT task, task <> 'open_orders' AS reconciled, count(*) AS records FROM records GROUP BY task")
def trigger_signature_diff(spark, sf_dir):
    """A changed filter makes its task unreconciled, an equal one does not; and the records that each of them has."""
    stored = {OPEN.name: reconcile.Control("another filter", 1, True), URGENT.name: reconcile.Control(URGENT.signature(), 1, True)}
    controls = reconcile.to_frame(spark, reconcile.trigger_changes(REGISTRY, stored)).select("task", "reconciled")
    return records(spark, sf_dir).groupBy("task").agg(F.count("*").alias("records")).join(F.broadcast(controls), "task")  # a row for each task


@query(_SQL + f"SELECT {_MERGED} FROM both_ WHERE NOT (task = 'urgent_orders' AND NOT planned AND updated_at < {SQL_NOW})")
def reconcile_all(spark, sf_dir):
    """Plan all tasks over the whole source, then clean up."""
    state, _ = reconcile.reconcile(lambda name: table(spark, sf_dir, name), REGISTRY, {}, records(spark, sf_dir), NOW)
    return _rows(state)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY 1")
def reconcile_resume(spark, sf_dir):
    """A keyed scan that goes on behind a checkpoint made for the same tasks."""
    last = reconcile.resume_after(({OPEN.name, URGENT.name}, 500), {URGENT.name, OPEN.name})
    return reconcile.keys_after(table(spark, sf_dir, "orders"), "o_orderkey", last)


# Scheduled jobs

_DUE = f"(locked_till IS NULL OR locked_till < {SQL_NOW}) AND (run_since <= {SQL_NOW} OR run_immediately)"


@query(f"WITH {SQL_JOBS} SELECT id, row_number() OVER (ORDER BY run_immediately DESC, run_since ASC, finished_at ASC NULLS FIRST, id) AS place FROM jobs WHERE {_DUE}")
def cron_due_order(spark, sf_dir):
    """All due jobs and their places."""
    d = cron.due(jobs(spark, sf_dir), NOW)
    place = F.row_number().over(W.orderBy(F.desc("run_immediately"), "run_since", F.get("run_log", F.lit(0))["finished_at"].asc_nulls_first(), "id"))
    return d.select("id", place.cast("long").alias("place"))


@query(
    f"WITH {SQL_JOBS} SELECT id, CASE WHEN locked_till > {SQL_NOW} THEN 'running' WHEN run_immediately THEN 'scheduled' WHEN error IS NOT NULL THEN 'failed' ELSE 'idle' END AS status, "
    "CAST(epoch_ms(finished_at) - epoch_ms(started_at) AS BIGINT) AS duration_ms FROM jobs WHERE regexp_matches(id, 'SUPPLIER', 'i') ORDER BY run_since ASC NULLS LAST, id LIMIT 50"
)
def cron_list_status(spark, sf_dir):
    return cron.listing(jobs(spark, sf_dir), NOW, search="supplier").select("id", "status", "duration_ms")


@query(f"WITH {SQL_JOBS} SELECT CAST(least(5000, greatest(0, epoch_ms(min(run_since)) - epoch_ms({SQL_NOW}))) AS BIGINT) AS wait_ms FROM jobs WHERE locked_till IS NULL OR locked_till < {SQL_NOW}")
def cron_next_wait(spark, sf_dir):
    return cron.next_wait_ms(jobs(spark, sf_dir), NOW)


@query(f"WITH {SQL_JOBS} SELECT id, CASE WHEN {_DUE} THEN 1 ELSE 0 END + CASE WHEN started_at IS NULL THEN 0 ELSE 1 END AS runs, NOT ({_DUE}) AND run_immediately AS asked, CAST(epoch_ms(CASE WHEN {_DUE} THEN {SQL_NOW} + INTERVAL 5 MINUTE ELSE locked_till END) AS BIGINT) AS lock_ms FROM jobs")
def cron_start(spark, sf_dir):
    """Start all due jobs: a bounded push to their logs."""
    all_jobs = jobs(spark, sf_dir)
    picked = cron.due(all_jobs, NOW).select("id", F.lit(True).alias("hit"))
    s = cron.start(all_jobs.join(picked, "id", "left"), F.col("hit").isNotNull(), NOW, NOW + timedelta(minutes=5))
    return s.select("id", F.size("run_log").alias("runs"), F.col("run_immediately").alias("asked"), _epoch("locked_till").alias("lock_ms"))


@query(
    f"WITH {SQL_JOBS} SELECT id, CAST(epoch_ms(CASE WHEN {_DUE} THEN {SQL_NOW} + INTERVAL 1 DAY + INTERVAL 1 MINUTE ELSE run_since END) AS BIGINT) AS next_ms, CAST(epoch_ms(CASE WHEN NOT coalesce({_DUE}, FALSE) THEN locked_till END) AS BIGINT) AS lock_ms, "
    f"CASE WHEN {_DUE} THEN CASE WHEN id LIKE '%1' THEN 'broken' END ELSE error END AS error, CAST(epoch_ms(CASE WHEN {_DUE} THEN {SQL_NOW} + INTERVAL 1 MINUTE ELSE finished_at END) AS BIGINT) AS finished_ms, "
    f"CASE WHEN {_DUE} THEN 1 ELSE 0 END + CASE WHEN started_at IS NULL THEN 0 ELSE 1 END AS runs FROM jobs"
)
def cron_finish(spark, sf_dir):
    """All due jobs run for a minute: log, lock and next time."""
    all_jobs, end = jobs(spark, sf_dir), NOW + timedelta(minutes=1)
    picked = cron.due(all_jobs, NOW).select("id", F.lit(True).alias("hit"))
    started = cron.start(all_jobs.join(picked, "id", "left"), F.col("hit").isNotNull(), NOW, NOW + timedelta(minutes=5)).drop("hit")
    done = cron.finish(started, picked.select("id", F.when(F.col("id").endswith("1"), "broken").alias("error")), end)
    last = F.get("run_log", F.lit(0))
    return done.select("id", _epoch("run_since").alias("next_ms"), _epoch("locked_till").alias("lock_ms"), last["error"].alias("error"), _epoch(last["finished_at"]).alias("finished_ms"), F.size("run_log").alias("runs"))


@query("SELECT s_name AS id FROM supplier UNION SELECT 'new-job'")
def cron_insert_missing(spark, sf_dir):
    fresh = spark.createDataFrame([("new-job", "1h", NOW)], "id string, interval string, run_since timestamp_ntz")
    known = jobs(spark, sf_dir).select("id", "interval", "run_since")
    return cron.insert_missing(jobs(spark, sf_dir), fresh.unionByName(known)).select("id")


# Metrics


@query(
    f"WITH {SQL_EXECUTIONS}, b(le, bound) AS (VALUES " + ", ".join(f"('{b}', {b})" for b in metrics.BUCKETS) + ", ('+Inf', CAST('inf' AS DOUBLE))) "
    "SELECT task, status, le, count(*) FILTER (duration_ms / 1000.0 <= bound) AS n FROM executions, b GROUP BY ALL"
)
def metric_histogram(spark, sf_dir):
    """Cumulative duration buckets."""
    return metrics.histogram(executions(spark, sf_dir))


@query(f"WITH {SQL_EXECUTIONS} SELECT task, count(*) FILTER (attempts > 1) AS retries FROM executions GROUP BY 1")
def metric_retries(spark, sf_dir):
    return metrics.retries(executions(spark, sf_dir))


_LAG = f"SELECT task, CAST(greatest(0, coalesce(date_diff('second', min(CASE WHEN status = 'pending' THEN due_at END), {SQL_NOW}), 0)) AS BIGINT) AS lag_s FROM records GROUP BY task"


@query(f"WITH {SQL_RECORDS} {_LAG}")
def metric_lag(spark, sf_dir):
    return metrics.lag(records(spark, sf_dir), NOW)


@query(f"WITH {SQL_RECORDS} SELECT max(lag_s) AS lag_s FROM ({_LAG})")
def metric_max_lag(spark, sf_dir):
    return metrics.lag(records(spark, sf_dir), NOW).agg(F.max("lag_s").alias("lag_s"))


@query(f"WITH {SQL_RECORDS} {_LAG} ORDER BY lag_s DESC, task LIMIT 10")
def metric_top_lag(spark, sf_dir):
    return metrics.top_lag(records(spark, sf_dir), NOW)


@query(f"WITH {SQL_RECORDS} SELECT task, status, count(*) AS depth FROM records GROUP BY ALL")
def metric_queue_composition(spark, sf_dir):
    return metrics.queue(records(spark, sf_dir))


@query(f"WITH {SQL_RECORDS} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS active FROM records")
def metric_depths(spark, sf_dir):
    q = metrics.queue(records(spark, sf_dir))
    return q.agg(F.sum(F.when(F.col("status") == "pending", F.col("depth")).otherwise(0)).alias("pending"), F.sum(F.when(F.col("status") == "processing", F.col("depth")).otherwise(0)).alias("active"))


_START = "CAST(epoch_ms(time_bucket(INTERVAL {s} SECOND, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start_ms"


@query(f"WITH {SQL_RECORDS} SELECT task, CAST(epoch(max(updated_at)) AS BIGINT) AS seconds FROM records GROUP BY task")
def metric_last_reconciled(spark, sf_dir):
    """Tasks that were reconciled when their records last changed."""
    found = records(spark, sf_dir).groupBy("task").agg(F.max("updated_at").alias("last_reconciled_at"))
    return metrics.last_reconciled(found)


def _windowed(df):
    return df.withColumn("start_ms", _epoch("start")).drop("start")


@query(f"WITH {SQL_EXECUTIONS} SELECT {_START.format(s=300)}, CAST(100.0 * count(*) FILTER (status = 'completed') / count(*) AS DECIMAL(9,3)) AS score FROM executions GROUP BY 1")
def metric_health_score(spark, sf_dir):
    return _windowed(metrics.health(executions(spark, sf_dir))).withColumn("score", F.col("score").cast("decimal(9,3)"))


@query(f"WITH {SQL_EXECUTIONS} SELECT {_START.format(s=60)}, CAST(count(*) / 60.0 AS DECIMAL(9,4)) AS rate FROM executions GROUP BY 1")
def metric_ops_rate(spark, sf_dir):
    return _windowed(metrics.rates(executions(spark, sf_dir), 60)).withColumn("rate", F.col("rate").cast("decimal(9,4)"))


@query(f"WITH {SQL_EXECUTIONS} SELECT {_START.format(s=60)}, task, CAST(count(*) / 60.0 AS DECIMAL(9,4)) AS rate FROM executions GROUP BY ALL")
def metric_throughput(spark, sf_dir):
    return _windowed(metrics.rates(executions(spark, sf_dir), 60, by_task=True)).withColumn("rate", F.col("rate").cast("decimal(9,4)"))


@query(f"WITH {SQL_EXECUTIONS} SELECT {_START.format(s=300)}, task, CAST(count(*) / 300.0 AS DECIMAL(9,4)) AS rate FROM executions WHERE status = 'failed' GROUP BY ALL")
def metric_failures_rate(spark, sf_dir):
    return _windowed(metrics.rates(executions(spark, sf_dir), 300, by_task=True, failed=True)).withColumn("rate", F.col("rate").cast("decimal(9,4)"))


@query(
    f"WITH {SQL_EXECUTIONS} SELECT {_START.format(s=3600)}, CASE " + " ".join(f"WHEN duration_ms / 1000.0 <= {b} THEN '{b}'" for b in metrics.BUCKETS) + " ELSE '+Inf' END AS le, count(*) AS n FROM executions GROUP BY ALL"
)
def metric_duration_heatmap(spark, sf_dir):
    return _windowed(metrics.heatmap(executions(spark, sf_dir), 3600))


@query("SELECT event_id, user_id, CAST(CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS DECIMAL(18,4)) AS increase FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)")
def metric_increase(spark, sf_dir):
    """How much counters rose, restarts taken into account."""
    return metrics.increase(table(spark, sf_dir, "events"), ["user_id"]).select("event_id", "user_id", F.col("increase").cast("decimal(18,4)").alias("increase"))


#: Samples of each type's counter, with restarts wherever it falls, and in ranges of five minutes at every full minute: what
#: each rose by since the one before, its first and last sample, and how far these are from the range's ends.
_RANGES = """c AS (SELECT event_type, ts, value, epoch_us(ts) AS us, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events),
s AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS rise FROM c),
e AS (SELECT *, unnest(range((us + 59999999) // 60000000, (us + 359999999) // 60000000)) AS step FROM s),
g AS (SELECT event_type, step, count(*) AS n, sum(rise) - arg_min(rise, us) AS rose, arg_min(value, us) AS first, min(us) AS a, max(us) AS b FROM e GROUP BY ALL HAVING count(*) > 1),
d AS (SELECT *, (b - a) / (n - 1.0) AS mean, a - (step * 60000000 - 300000000) AS head, step * 60000000 - b AS tail FROM g),
h AS (SELECT *, CASE WHEN head >= 1.1 * mean THEN mean / 2 ELSE head END AS before, CASE WHEN tail >= 1.1 * mean THEN mean / 2 ELSE tail END AS after FROM d),
r AS (SELECT event_type, step, n, rose * ((b - a) + CASE WHEN rose > 0 AND first >= 0 THEN least(before, (b - a) * first / rose) ELSE before END + after) / (b - a) AS increase FROM h)"""


def _ranges(spark, sf_dir):
    return metrics.ranges(table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value"), ["event_type"], 300, 60)


@query(f"WITH {_RANGES} SELECT event_type, CAST(step * 60 AS BIGINT) AS at_s, n, CAST(increase AS DECIMAL(18,4)) AS increase FROM r")
def metric_increase_5m(spark, sf_dir):
    """By how much counters rose in the five minutes up to every minute, drawn out to the range's ends."""
    return _ranges(spark, sf_dir).select("event_type", "at_s", "n", F.col("increase").cast("decimal(18,4)").alias("increase"))


@query(f"WITH {_RANGES} SELECT event_type, CAST(step * 60 AS BIGINT) AS at_s, CAST(increase / 300 AS DECIMAL(18,6)) AS rate FROM r")
def metric_rate_5m(spark, sf_dir):
    return _ranges(spark, sf_dir).select("event_type", "at_s", F.col("rate").cast("decimal(18,6)").alias("rate"))


@query(f"WITH {_RANGES} SELECT CAST(step * 60 AS BIGINT) AS at_s, CAST(100 * sum(CASE WHEN event_type <> 'error' THEN increase ELSE 0 END) / nullif(sum(increase), 0) AS DECIMAL(18,4)) AS score FROM r GROUP BY step")
def metric_health_5m(spark, sf_dir):
    """The share of what didn't fail in the rates of all counters."""
    return metrics.health_of(_ranges(spark, sf_dir), F.col("event_type") != "error").select("at_s", F.col("score").cast("decimal(18,4)").alias("score"))


def _instances(spark, sf_dir):
    """An instance has one metric for each type of its events, and the number of all its events."""
    e = table(spark, sf_dir, "events").withColumn("id", F.col("event_id") % 7)
    counts = e.groupBy("id", "event_type").agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("seen"), F.count("*").alias("n"))
    metric = F.struct(F.lit("runs").alias("name"), F.create_map(F.lit("task"), F.col("event_type")).alias("labels"), F.col("n").cast("double").alias("value"))
    return counts.groupBy("id").agg(F.max("seen").alias("last_seen"), F.collect_list(metric).alias("metrics"), F.sum("n").alias("events"))


@query("SELECT 'runs' AS name, event_type AS task, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY event_type")
def metric_cluster_sum(spark, sf_dir):
    """Metrics of all instances summed by name and labels."""
    return metrics.cluster(_instances(spark, sf_dir)).select("name", F.get("labels", F.lit(0))["value"].alias("task"), "value")


@query("SELECT event_id % 7 AS id, CASE WHEN event_id % 7 = 3 THEN 0 ELSE count(*) END AS n FROM events GROUP BY 1")
def metric_register(spark, sf_dir):
    """An instance replaces its own row in the registry."""
    all_ = _instances(spark, sf_dir)
    me = all_.filter("id = 3").withColumns({"metrics": F.slice("metrics", 1, 0), "events": F.lit(0).cast("long")})
    return metrics.register(all_, me, NOW).select("id", F.col("events").alias("n"))


# Change events

_EVENTS = "c AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS key, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS operation FROM events)"
_LATEST = "l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1)"


@query(f"WITH {_EVENTS}, {_LATEST} SELECT key, event_id, operation FROM l")
def cdc_latest_per_key(spark, sf_dir):
    return streaming.latest(change_events(spark, sf_dir)).select("key", "event_id", "operation")


@query(f"WITH {_EVENTS}, {_LATEST} SELECT operation, count(*) AS n FROM l GROUP BY 1")
def cdc_route_counts(spark, sf_dir):
    e = streaming.wanted(change_events(spark, sf_dir), REGISTRY)
    return streaming.latest(e).groupBy("operation").agg(F.count("*").alias("n"))


@query(
    f"WITH {_EVENTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY key ORDER BY ts)), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts) AS n FROM g) SELECT key, CAST(epoch_us(max(ts) + INTERVAL 1 HOUR) AS BIGINT) AS run_us, count(*) AS events FROM s GROUP BY key, n"
)
def cdc_debounce_sessions(spark, sf_dir):
    """When a task with an hour of debounce would run."""
    return streaming.debounced(change_events(spark, sf_dir), "1 hour", "key").select("key", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("run_at")).alias("run_us"), "events")


@query(f"WITH {_EVENTS} SELECT CAST(greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) // 1000000) AS BIGINT) AS lag_s FROM c")
def cdc_lag(spark, sf_dir):
    return streaming.lag_s(change_events(spark, sf_dir), datetime(2024, 2, 1))


@query(
    f"WITH {SQL_RECORDS}, {_EVENTS}, {_LATEST}, {_PLANNED}, gone AS (SELECT key FROM l WHERE operation = 'delete'), up AS (SELECT key FROM l WHERE operation <> 'delete'), "
    f"kept AS (SELECT * FROM records WHERE NOT (source_doc_id IN (SELECT key FROM gone) AND updated_at < {SQL_NOW} AND "
    "CASE WHEN task = 'open_orders' THEN source_doc_id NOT IN (SELECT o_orderkey FROM orders) ELSE source_doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') END)), "
    f"touched AS (SELECT * FROM planned WHERE source_doc_id IN (SELECT key FROM up)), {_both('kept', 'touched')} SELECT {_MERGED} FROM both_"
)
def cdc_apply_batch(spark, sf_dir):
    """The state after one batch of change events."""
    return _rows(streaming.apply_events(change_events(spark, sf_dir), Sources.of_parquet(spark, sf_dir, ["orders"]), REGISTRY, records(spark, sf_dir), NOW))


# Handlers


@query(f"WITH {SQL_RECORDS} SELECT r.task, source_doc_id, o_orderpriority AS priority FROM records r JOIN orders ON source_doc_id = o_orderkey WHERE r.status = 'processing' AND o_orderpriority = '1-URGENT'")
def handler_documents(spark, sf_dir):
    """Claimed records with the row they are for, one column of it, where the task's filter still holds."""
    o = table(spark, sf_dir, "orders")
    rows = o.filter(Filters(o.schema, NOW).where(URGENT.filter))
    claimed = records(spark, sf_dir).filter("status = 'processing'").select(*KEYS)
    return with_source_row(claimed, rows, "o_orderkey", ["o_orderpriority"]).select(*KEYS, F.col("document.o_orderpriority").alias("priority"))


@query(f"WITH {SQL_RECORDS} SELECT task, CASE WHEN source_doc_id % 4 = 1 THEN 'failed' ELSE 'completed' END AS outcome, count(*) AS n FROM records WHERE status = 'processing' OR status = 'processing_dirty' GROUP BY 1, 2")
def handler_outcomes(spark, sf_dir):
    """User code over all claimed records, on the executors."""

    def handler(record):
        if record["source_doc_id"] % 4 == 1:
            raise ValueError("odd key")

    claimed = records(spark, sf_dir).filter("status in ('processing', 'processing_dirty')").select(*KEYS)
    return run_handlers(claimed, handler).groupBy("task", "outcome").agg(F.count("*").alias("n"))


def _handle(record):
    """Odd keys fail, every fifth waits, and a cheap order throttles its task."""
    key, price = record["source_doc_id"], record["document"]["o_totalprice"]
    if key % 4 == 1:
        raise ValueError("odd key")
    if key % 5 == 0:
        raise Defer("1h")
    return Throttle("2h") if price < 50_000 else None


WORKERS = Registry(*(replace(d, handler=_handle, retry=RetryPolicy(*p, max_attempts=4)) for d, p in ((OPEN, ("fixed", "5s")), (URGENT, ("linear", "1m")))))


@query(
    f"WITH {SQL_RECORDS}, {_PLANNED}, d AS (SELECT * FROM records WHERE next_run_at <= {SQL_NOW} ORDER BY next_run_at, task, source_doc_id LIMIT 500), "
    "w AS (SELECT d.*, p.task IS NOT NULL AND p.observed = d.observed AS valid, d.source_doc_id % 4 = 1 AS bad, d.source_doc_id % 5 = 0 AS later, p.debounce_ms FROM d LEFT JOIN planned p ON p.task = d.task AND p.source_doc_id = d.source_doc_id), "
    f"o AS (SELECT task AS t, source_doc_id AS i, CASE WHEN NOT valid OR NOT (bad OR later) THEN 'completed' WHEN bad AND attempts + 1 >= 4 THEN 'failed' ELSE 'pending' END AS s, CASE WHEN valid AND later AND NOT bad THEN 0 ELSE attempts + 1 END AS a, "
    f"CASE WHEN NOT valid OR NOT (bad OR later) OR (bad AND attempts + 1 >= 4) THEN NULL WHEN bad AND task = 'open_orders' THEN {SQL_NOW} + INTERVAL 5 SECOND WHEN bad THEN {SQL_NOW} + (attempts + 1) * INTERVAL 1 MINUTE ELSE {SQL_NOW} + INTERVAL 1 HOUR END AS n, "
    f"CASE WHEN valid AND bad THEN 'odd key' WHEN valid AND later THEN last_error END AS e FROM w) "
    "SELECT task, source_doc_id, coalesce(s, status) AS status, CAST(CASE WHEN t IS NULL THEN attempts ELSE a END AS INTEGER) AS attempts, CAST(epoch_ms(CASE WHEN t IS NULL THEN next_run_at ELSE n END) AS BIGINT) AS next_ms, CASE WHEN t IS NULL THEN last_error ELSE e END AS last_error "
    "FROM records LEFT JOIN o ON task = t AND source_doc_id = i"
)
def work_once(spark, sf_dir):
    """One round over the first 500 due records: claim, late binding, handlers with rows, each task's policy."""
    s = worker.work(records(spark, sf_dir), Sources.of_parquet(spark, sf_dir, ["orders"]), WORKERS, NOW, 500, columns={"orders": ["o_totalprice"]})
    return s.select(*KEYS, "status", "attempts", _epoch("next_run_at").alias("next_ms"), "last_error")


@query(
    f"WITH {SQL_RECORDS}, {_PLANNED} SELECT r.task, CAST(epoch_ms({SQL_NOW} + INTERVAL 2 HOUR) AS BIGINT) AS until_ms FROM records r JOIN planned p ON p.task = r.task AND p.source_doc_id = r.source_doc_id AND p.observed = r.observed "
    f"WHERE r.next_run_at <= {SQL_NOW} AND r.source_doc_id % 4 <> 1 AND r.source_doc_id % 5 <> 0 AND p.observed < 50000 GROUP BY 1"
)
def handler_throttles(spark, sf_dir):
    """Which tasks handlers of all due records hold back, and until when."""
    due = records(spark, sf_dir).filter(transitions.is_due(NOW))
    said = worker.outcomes(due, Sources.of_parquet(spark, sf_dir, ["orders"]), WORKERS, NOW)
    return said.groupBy("task").agg(_epoch(F.max("throttle")).alias("until_ms")).filter("until_ms is not null")


from . import live  # noqa: E402,F401  it registers its queries, which build on these
