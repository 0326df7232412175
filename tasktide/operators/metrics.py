"""Metrics over executions and records: histograms, lag, rates, and the sum over instances.

Executions are rows (ts, task, status, duration_ms, attempts). Rates are counts of a window over its seconds.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds of duration buckets in seconds; the last bucket, +Inf, holds all.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def histogram(executions: DataFrame, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """task, status, le, n: how many executions took at most le seconds. One aggregation, then one row for each bound."""
    seconds = F.col("duration_ms") / 1000
    counts = [F.count_if(seconds <= b) for b in buckets]
    grouped = executions.groupBy("task", "status").agg(*(c.alias(f"b{i}") for i, c in enumerate(counts)), F.count("*").alias("all"))
    rows = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return grouped.select("task", "status", F.explode(rows).alias("x")).select("task", "status", "x.le", "x.n")


def retries(executions: DataFrame) -> DataFrame:
    return executions.groupBy("task").agg(F.count_if(F.col("attempts") > 1).alias("retries"))


def lag(records: DataFrame, now: datetime) -> DataFrame:
    """Seconds since the first due time of pending records, by task; not below 0."""
    first = F.min(F.when(F.col("status") == "pending", F.col("due_at")))
    late = F.timestamp_diff("SECOND", first, F.lit(now).cast("timestamp_ntz"))
    return records.groupBy("task").agg(F.greatest(F.lit(0), F.coalesce(late, F.lit(0))).cast("long").alias("lag_s"))


def queue(records: DataFrame) -> DataFrame:
    return records.groupBy("task", "status").agg(F.count("*").alias("depth"))


def top_lag(records: DataFrame, now: datetime, n: int = 10) -> DataFrame:
    return lag(records, now).orderBy(F.desc("lag_s"), "task").limit(n)


def last_reconciled(controls: DataFrame) -> DataFrame:
    """Epoch seconds of each task's last reconciliation, 0 before the first."""
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("last_reconciled_at"))
    return controls.select("task", F.coalesce(seconds, F.lit(0)).cast("long").alias("seconds"))


def _window(size: str) -> Column:
    return F.window("ts", size)["start"].alias("start")


def rates(executions: DataFrame, seconds: int, by_task: bool = False, failed: bool = False) -> DataFrame:
    """Executions, or failures, a second in each window."""
    rows = executions.filter("status = 'failed'") if failed else executions
    return rows.groupBy(_window(f"{seconds} seconds"), *(["task"] if by_task else [])).agg((F.count("*") / F.lit(float(seconds))).alias("rate"))


def health(executions: DataFrame, seconds: int = 300) -> DataFrame:
    """Percent of executions of each window that succeeded."""
    return executions.groupBy(_window(f"{seconds} seconds")).agg((100.0 * F.count_if(F.col("status") == "completed") / F.count("*")).alias("score"))


def heatmap(executions: DataFrame, seconds: int, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Executions by window and by the smallest bound that holds them."""
    bound = F.lit("+Inf")
    for b in reversed(buckets):
        bound = F.when(F.col("duration_ms") / 1000 <= b, str(b)).otherwise(bound)
    return executions.groupBy(_window(f"{seconds} seconds"), bound.alias("le")).agg(F.count("*").alias("n"))


def increase(samples: DataFrame, series: list[str]) -> DataFrame:
    """Counter samples (ts, value): by how much each rose since the one before; a fall is a restart and counts from 0."""
    before = F.lag("value").over(W.partitionBy(*series).orderBy("ts"))
    return samples.withColumn("increase", F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before).cast("double"))


def ranges(samples: DataFrame, series: list[str], seconds: int, step_s: int, chunk_s: int = 86_400) -> DataFrame:
    """Counter samples (ts, value) over sliding ranges: for each series and each multiple of step_s whose range, the `seconds`
    up to it, holds two samples or more: at_s (epoch seconds), n, increase and rate (a second).

    What a counter rose by from sample to sample, restarts taken into account, is summed over the range but for its first
    sample, and drawn out to the range's ends: up to half the mean distance of samples where an end is further off than 1.1 of
    it, and not to before the counter was 0. The rise over a sample before is found within chunks of chunk_s, whose last
    samples are handed on as one row for each, so that a long series isn't one task's; the ranges are map-side sums."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    rows = samples.select(*series, F.col("value").cast("double").alias("value"), us.alias("us")).withColumn("chunk", F.floor(F.col("us") / (chunk_s * 1_000_000)))
    last = rows.groupBy(*series, "chunk").agg(F.max_by("value", "us").alias("last"))
    handed = last.withColumn("last", F.lag("last").over(W.partitionBy(*series).orderBy("chunk")))
    before = F.coalesce(F.lag("value").over(W.partitionBy(*series, "chunk").orderBy("us")), "last")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*series, "chunk"]]
    joined = rows.alias("r").join(handed.alias("h"), on, "left").select("r.*", "h.last").withColumn("before", before)
    rise = F.when(F.col("before").isNull(), 0.0).when(F.col("value") < F.col("before"), F.col("value")).otherwise(F.col("value") - F.col("before"))
    step, length = step_s * 1_000_000, seconds * 1_000_000
    up = lambda x: F.ceil(x / step)
    # A range is open at its begin: a sample is in those of the steps from its time on, before its time plus the range's length.
    steps = joined.select(*series, "value", "us", rise.alias("rise"), F.explode(F.sequence(up(F.col("us")), up(F.col("us") + length) - 1)).alias("step"))
    found = steps.groupBy(*series, "step").agg(F.count("*").alias("n"), (F.sum("rise") - F.min_by("rise", "us")).alias("rose"), F.min_by("value", "us").alias("first"), F.min("us").alias("a"), F.max("us").alias("b"))
    at, seen = F.col("step") * step, F.col("b") - F.col("a")
    mean = seen / (F.col("n") - 1)
    drawn = lambda gap: F.when(gap >= 1.1 * mean, mean / 2).otherwise(gap)
    head, tail = drawn(F.col("a") - (at - length)), drawn(at - F.col("b"))
    head = F.when((F.col("rose") > 0) & (F.col("first") >= 0), F.least(head, seen * F.col("first") / F.col("rose"))).otherwise(head)
    out = found.filter("n > 1 and b > a").withColumn("increase", F.col("rose") * (seen + head + tail) / seen)
    return out.select(*series, (F.col("step") * step_s).alias("at_s"), "n", "increase", (F.col("increase") / seconds).alias("rate"))


def health_of(ranges: DataFrame, good: Column) -> DataFrame:
    """Percent of the rates of all series, at each step, that the good ones have; null where nothing rose."""
    found = ranges.groupBy("at_s").agg(F.sum(F.when(good, F.col("rate")).otherwise(0.0)).alias("good"), F.sum("rate").alias("all"))
    return found.select("at_s", (100 * F.try_divide("good", "all")).alias("score"))


def cluster(instances: DataFrame) -> DataFrame:
    """instances (id, last_seen, metrics array<struct<name, labels map, value>>): the sums by name and labels."""
    each = instances.select(F.explode("metrics").alias("m"))
    return each.groupBy(F.col("m.name").alias("name"), F.array_sort(F.map_entries("m.labels")).alias("labels")).agg(F.sum("m.value").alias("value"))


def register(instances: DataFrame, me: DataFrame, now: datetime, stale_ms: int | None = None) -> DataFrame:
    """The registry with an instance's new row in place of its old one; without stale rows if stale_ms is given."""
    kept = instances.join(me.select("id"), "id", "left_anti").select(instances.columns)
    if stale_ms is not None:
        kept = kept.filter(F.timestamp_diff("MILLISECOND", F.col("last_seen"), F.lit(now).cast("timestamp_ntz")) < stale_ms)
    return kept.unionByName(me)
