"""The driver's tables in the roles of the model, in Spark and as SQL: task records, executions, jobs, change events.

Records are derived from orders, so that both engines see the same rows; see FIXTURES.md, part B.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CleanupPolicy, Registry, RetryPolicy, TaskDefinition

NOW = datetime(1998, 8, 1)
SQL_NOW = "TIMESTAMP '1998-08-01'"

OPEN = TaskDefinition("open_orders", "orders", "o_orderkey", {"o_orderstatus": "O"}, {"o_totalprice": 1}, cleanup=CleanupPolicy(keep_for=0))
URGENT = TaskDefinition("urgent_orders", "orders", "o_orderkey", {"o_orderpriority": "1-URGENT"}, {"o_totalprice": 1}, debounce="5s", retry=RetryPolicy("linear", interval="1m"), cleanup=CleanupPolicy("source_deleted_or_not_matching", 0))
REGISTRY = Registry(OPEN, URGENT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task records of nine tenths of the orders, with all columns of the state."""
    o, k = table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 9"), F.col("o_orderkey")
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'processing_dirty' ELSE 'failed' END END")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    s = o.select(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'open_orders' ELSE 'urgent_orders' END").alias("task"), k.alias("source_doc_id"), status.alias("status"), (k % 6).cast("int").alias("attempts"), at.alias("due_at"), "o_orderkey", "o_totalprice")
    idle = F.col("status").isin("completed", "failed")
    history = F.when(idle, F.array(F.struct(F.col("due_at").alias("at"), F.col("status"), (F.col("o_orderkey") % 900).alias("duration_ms"), F.lit(None).cast("string").alias("error"))))
    return s.select(
        "task", "source_doc_id", "status", "attempts", F.when(~idle, F.col("due_at")).alias("next_run_at"), "due_at", F.col("due_at").alias("created_at"), F.col("due_at").alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"), F.when(F.col("status") == "completed", F.col("due_at")).alias("completed_at"), F.when(F.col("status") == "failed", F.col("due_at")).alias("first_error_at"),
        F.expr("CASE WHEN status = 'failed' THEN 'Timeout error' WHEN o_orderkey % 7 = 0 THEN 'Rate limited' END").alias("last_error"), F.when(idle, F.col("due_at")).alias("last_finalized_at"),
        F.struct(F.expr("CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END").alias("o_totalprice")).alias("observed"),
        F.lit(None).cast("struct<at:timestamp_ntz,duration_ms:bigint>").alias("last_success"), history.cast("array<struct<at:timestamp_ntz,status:string,duration_ms:bigint,error:string>>").alias("history"), F.lit(True).alias("reset_on_change"),
    )


SQL_RECORDS = """r AS (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'open_orders' ELSE 'urgent_orders' END AS task, o_orderkey AS source_doc_id,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE
      CASE o_orderkey % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'processing_dirty' ELSE 'failed' END END AS status,
    CAST(o_orderkey % 6 AS INTEGER) AS attempts, CAST(o_orderdate AS TIMESTAMP) AS due_at,
    CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS observed
  FROM orders WHERE o_orderkey % 10 <> 9),
records AS (
  SELECT *, CASE WHEN status NOT IN ('completed', 'failed') THEN due_at END AS next_run_at, due_at AS updated_at,
    CASE WHEN status = 'failed' THEN due_at END AS first_error_at,
    CASE WHEN status = 'failed' THEN 'Timeout error' WHEN source_doc_id % 7 = 0 THEN 'Rate limited' END AS last_error
  FROM r)"""


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as executions: value is the duration, type error the failures, type the task."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("task"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.round(F.col("value") * 10).cast("long").alias("duration_ms"), (F.col("event_id") % 4).cast("int").alias("attempts"), "user_id")


SQL_EXECUTIONS = """executions AS (
  SELECT CAST(ts AS TIMESTAMP) AS ts, event_type AS task, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
    CAST(round(value * 10) AS BIGINT) AS duration_ms, CAST(event_id % 4 AS INTEGER) AS attempts, user_id FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as scheduled jobs, with one run in the log for most."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    day = lambda n: F.lit(NOW).cast("timestamp_ntz") + F.make_dt_interval(n)
    started = day((-(k % 9)).cast("int"))
    run = F.struct(started.alias("started_at"), (started + F.make_dt_interval(hours=(k % 5 * 11).cast("int"))).alias("finished_at"), F.when(k % 4 == 0, "boom").alias("error"))
    return s.select(
        F.col("s_name").alias("id"), F.lit("1d").alias("interval"), day((k % 7 - 4).cast("int")).alias("run_since"), (k % 5 == 0).alias("run_immediately"), F.when(k % 3 == 0, day((k % 2 * 2 - 1).cast("int"))).alias("locked_till"),
        F.when(k % 6 == 0, F.array().cast("array<struct<started_at:timestamp_ntz,finished_at:timestamp_ntz,error:string>>")).otherwise(F.array(run)).alias("run_log"),
    )


SQL_JOBS = f"""jobs AS (
  SELECT s_name AS id, {SQL_NOW} + (s_suppkey % 7 - 4) * INTERVAL 1 DAY AS run_since, s_suppkey % 5 = 0 AS run_immediately,
    CASE WHEN s_suppkey % 3 = 0 THEN {SQL_NOW} + (s_suppkey % 2 * 2 - 1) * INTERVAL 1 DAY END AS locked_till,
    CASE WHEN s_suppkey % 6 <> 0 THEN {SQL_NOW} - (s_suppkey % 9) * INTERVAL 1 DAY END AS started_at,
    CASE WHEN s_suppkey % 6 <> 0 THEN {SQL_NOW} - (s_suppkey % 9) * INTERVAL 1 DAY + (s_suppkey % 5) * 11 * INTERVAL 1 HOUR END AS finished_at,
    CASE WHEN s_suppkey % 6 <> 0 AND s_suppkey % 4 = 0 THEN 'boom' END AS error
  FROM supplier)"""


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of orders: the user's number is the order's key; an error is a delete."""
    e = table(spark, sf_dir, "events")
    operation = F.expr("CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END")
    return e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit("orders").alias("source"), F.col("user_id").alias("key"), operation.alias("operation"))
