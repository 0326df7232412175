"""Records of scheduled jobs: due order, status, run log."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.intervals import interval_function, ms_between

RUN = T.StructType().add("started_at", "timestamp_ntz").add("finished_at", "timestamp_ntz").add("error", "string")
SCHEMA = T.StructType().add("id", "string", False).add("interval", "string").add("run_since", "timestamp_ntz").add("run_immediately", "boolean").add("locked_till", "timestamp_ntz").add("run_log", T.ArrayType(RUN))
SORTS = {"id": "id", "next_run_at": "run_since", "run_since": "run_since"}


def _at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def insert_missing(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """New ids (id, interval, run_since) are added in their stored default form; known ones stay as they are."""
    fresh = new.join(jobs.select("id"), "id", "left_anti").select("id", "interval", "run_since", F.lit(False).alias("run_immediately"), F.lit(None).cast("timestamp_ntz").alias("locked_till"), F.array().cast(T.ArrayType(RUN)).alias("run_log"))
    return jobs.unionByName(fresh)


def due(jobs: DataFrame, now: datetime) -> DataFrame:
    """Unlocked jobs that are to run: those asked for by hand first, then by time, then by their last end."""
    unlocked = F.col("locked_till").isNull() | (F.col("locked_till") < _at(now))
    wanted = (F.col("run_since") <= _at(now)) | F.coalesce("run_immediately", F.lit(False))
    return jobs.filter(unlocked & wanted).orderBy(F.coalesce("run_immediately", F.lit(False)).desc(), F.col("run_since").asc_nulls_first(), F.get("run_log", F.lit(0))["finished_at"].asc_nulls_first(), "id")


def start(jobs: DataFrame, which: Column, now: datetime, lock_till: datetime) -> DataFrame:
    """Lock and log a start, newest first, of which five are kept. A wish to run by hand is fulfilled by it."""
    entry = F.struct(_at(now).alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(None).cast("string").alias("error"))
    newest = F.array_sort(F.array_append(F.coalesce("run_log", F.array().cast(T.ArrayType(RUN))), entry), lambda a, b: F.when(a["started_at"] > b["started_at"], -1).when(a["started_at"] < b["started_at"], 1).otherwise(0))
    hit = F.coalesce(which, F.lit(False))
    # The choice is a column of its own first: it may be about the columns that change.
    return (
        jobs.withColumn("__hit", hit)
        .withColumns(
            {
                "run_log": F.when(F.col("__hit"), F.slice(newest, 1, 5)).otherwise(F.col("run_log")),
                "locked_till": F.when(F.col("__hit"), _at(lock_till)).otherwise(F.col("locked_till")),
                "run_immediately": ~F.col("__hit") & F.coalesce("run_immediately", F.lit(False)),
            }
        )
        .drop("__hit")
    )


def undo_start(jobs: DataFrame, which: Column, asked: Column | None = None) -> DataFrame:
    """Take the newest entry of the log back. asked: whether the job had been asked for by hand, which then holds again."""
    rest = F.slice("run_log", F.lit(2), F.greatest(F.size("run_log") - 1, F.lit(0)))
    hit = F.coalesce(which, F.lit(False))
    again = F.lit(False) if asked is None else F.coalesce(asked, F.lit(False))
    return (
        jobs.withColumns({"__hit": hit, "__asked": again})
        .withColumns(
            {
                "run_log": F.when(F.col("__hit") & (F.size("run_log") > 0), rest).otherwise(F.col("run_log")),
                "locked_till": F.when(~F.col("__hit"), F.col("locked_till")),
                "run_immediately": F.coalesce("run_immediately", F.lit(False)) | (F.col("__hit") & F.col("__asked")),
            }
        )
        .drop("__hit", "__asked")
    )


def next_run(interval: Column, now: datetime, tz: str = "UTC") -> Column:
    """The time after now of each job's interval (milliseconds, a duration, or "CRON " and an expression); null for a null
    one. Each different text of a batch is evaluated once."""

    @F.pandas_udf("timestamp_ntz")
    def of(texts: pd.Series) -> pd.Series:
        known = {t: interval_function(int(t) if t.strip().isdigit() else t, tz)(now) for t in texts.dropna().unique()}
        return pd.to_datetime(texts.map(known))

    return of(interval)


def finish(jobs: DataFrame, outcomes: DataFrame, now: datetime, tz: str = "UTC") -> DataFrame:
    """After runs, outcomes (id, error; next_run where the interval isn't to be asked): the newest entry of the log gets its
    end and error, the lock goes, and the job is due at the next time of its interval."""
    given = F.col("next_run") if "next_run" in outcomes.columns else F.lit(None).cast("timestamp_ntz")
    ended = outcomes.select(F.col("id").alias("__id"), F.col("error").alias("__error"), given.cast("timestamp_ntz").alias("__next"), F.lit(True).alias("__ended"))
    both = jobs.join(ended, F.col("id") == F.col("__id"), "left").withColumn("__ended", F.coalesce("__ended", F.lit(False)))
    both = both.withColumn("__of", next_run(F.when(F.col("__ended") & F.col("__next").isNull(), F.col("interval")), now, tz))
    last = F.get("run_log", F.lit(0))
    entry = F.struct(last["started_at"].alias("started_at"), _at(now).alias("finished_at"), F.col("__error").alias("error")).cast(RUN)
    log = F.concat(F.array(entry), F.slice("run_log", F.lit(2), F.greatest(F.size("run_log") - 1, F.lit(0))))
    return both.withColumns(
        {
            "run_log": F.when(F.col("__ended") & (F.size("run_log") > 0), log).otherwise(F.col("run_log")),
            "locked_till": F.when(~F.col("__ended"), F.col("locked_till")),
            "run_since": F.when(F.col("__ended"), F.coalesce("__next", "__of")).otherwise(F.col("run_since")),
        }
    ).select(jobs.columns)


def trigger(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.withColumn("run_immediately", (F.col("id") == job_id) | F.coalesce("run_immediately", F.lit(False)))


def status(now: datetime) -> Column:
    """In this order: locked is running, asked for is scheduled, a last error is failed, else idle."""
    last = F.get("run_log", F.lit(0))
    return F.when(F.col("locked_till") > _at(now), "running").when(F.col("run_immediately"), "scheduled").when(last["error"].isNotNull(), "failed").otherwise("idle")


def listing(jobs: DataFrame, now: datetime, search: str | None = None, sort: str = "next_run_at", descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """id, status, next_run_at, last run and its duration; search is a case-insensitive pattern on ids."""
    found = jobs if search is None else jobs.filter(F.col("id").rlike("(?i)" + search))
    c = F.col(SORTS[sort])
    last = F.get("run_log", F.lit(0))
    shown = found.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "id").offset(offset).limit(limit)
    return shown.select("id", status(now).alias("status"), F.col("run_since").alias("next_run_at"), last["started_at"].alias("started_at"), last["error"].alias("error"), ms_between(last["started_at"], F.coalesce(last["finished_at"], _at(now))).alias("duration_ms"))


def next_wait_ms(jobs: DataFrame, now: datetime, most: int = 5_000) -> DataFrame:
    """How long to wait for the earliest unlocked job: 0 to most milliseconds."""
    first = jobs.filter(F.col("locked_till").isNull() | (F.col("locked_till") < _at(now))).agg(F.min("run_since").alias("first"))
    return first.select(F.least(F.lit(most), F.greatest(F.lit(0), F.coalesce(ms_between(_at(now), F.col("first")), F.lit(most)))).cast("long").alias("wait_ms"))
