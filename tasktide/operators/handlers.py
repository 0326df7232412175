"""Running user code over claimed records, and the batch executor."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import duration_ms

#: What a run gives back to finalize(); throttle is the time until which the handler wants no record of its task to run.
OUTCOMES = "task string, source_doc_id {key}, outcome string, duration_ms long, error string, until timestamp_ntz, throttle timestamp_ntz"


class Defer(Exception):
    """Raised by a handler to run again at a later time, or after a duration, with its attempts forgotten."""

    def __init__(self, until: datetime | int | float | str, throttle: datetime | int | float | str | None = None):
        super().__init__("deferred")
        self.until, self.throttle = until, throttle


class Throttle(Exception):
    """Raised or returned by a handler: this run is a success, and its whole task has to wait until then."""

    def __init__(self, until: datetime | int | float | str):
        super().__init__("throttled")
        self.until = until


class Skip(Exception):
    """Raised by a handler whose condition no longer holds: counts as a success."""


def _moment(value: datetime | int | float | str | None, now: datetime | None) -> datetime | None:
    """A time, or a duration from now."""
    if value is None or isinstance(value, datetime):
        return value
    if now is None:
        raise ValueError("a duration needs run_handlers' now")
    return now + timedelta(milliseconds=duration_ms(value))


def run_handlers(claimed: DataFrame, handler: Callable | dict[str, Callable], now: datetime | None = None, caller: Callable[[Callable[[], Any]], Any] = lambda run: run()) -> DataFrame:
    """Outcome rows of a handler, or of each task's, called with each claimed record, in Arrow batches on the executors. It
    may run again if an executor is lost: as for any task here, the last outcome counts. caller is called with each run as
    a function, to do something around it; what it raises is the run's error. Records whose column __valid is false are
    skipped without a call."""
    kind = claimed.schema["source_doc_id"].dataType.simpleString()
    pick = (lambda task: handler[task]) if isinstance(handler, dict) else lambda task: handler

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for record in batch.to_pylist():
                began, outcome, error, until, throttle = time.perf_counter(), "completed", None, None, None
                if not record.pop("__valid", True):
                    rows.append((record["task"], record["source_doc_id"], "skipped", 0, None, None, None))
                    continue
                try:
                    said = caller(lambda record=record: pick(record["task"])(record))
                    throttle = _moment(said.until, now) if isinstance(said, Throttle) else None
                except Throttle as e:
                    throttle = _moment(e.until, now)
                except Defer as e:
                    outcome, until, throttle = "deferred", _moment(e.until, now), _moment(e.throttle, now)
                except Skip:
                    outcome = "skipped"
                except Exception as e:  # whatever the handler raises is its outcome
                    outcome, error = "failed", str(e) or "Unknown error"
                rows.append((record["task"], record["source_doc_id"], outcome, int(1000 * (time.perf_counter() - began)), error, until, throttle))
            key = batch.schema.field("source_doc_id").type
            types = {"task": pa.string(), "source_doc_id": key, "outcome": pa.string(), "duration_ms": pa.int64(), "error": pa.string(), "until": pa.timestamp("us"), "throttle": pa.timestamp("us")}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))

    return claimed.mapInArrow(run, OUTCOMES.format(key=kind))


def with_source_row(claimed: DataFrame, source: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Claimed records with the row they are for, as it is now, in the column document; only the given columns are read.
    Records whose row is gone drop out. Filter the source first to have the task's condition hold as well."""
    row = F.struct(*(columns or source.columns)).alias("document")
    return claimed.join(source.select(F.col(key).alias("source_doc_id"), row), "source_doc_id")


def process_in_batches(rows: DataFrame, transform: Callable[[dict[str, Any]], Any], execute: Callable[[list], None], batch_size: int = 1000) -> dict[str, int]:
    """Each row gives none, one or a list of operations, executed in lists of batch_size or a few more; the counts of rows
    and operations. Rows of a partition are worked on in order where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list = []
        processed = performed = 0
        for batch in batches:
            for row in batch.to_dict("records"):
                made = transform(row)
                waiting += [] if made is None else made if isinstance(made, list) else [made]
                processed += 1
                if len(waiting) >= batch_size:
                    execute(waiting)
                    performed, waiting = performed + len(waiting), []
        if waiting:
            execute(waiting)
            performed += len(waiting)
        yield pd.DataFrame({"processed": [processed], "performed": [performed]})

    total = rows.mapInPandas(run, "processed long, performed long").agg(F.coalesce(F.sum("processed"), F.lit(0)).alias("p"), F.coalesce(F.sum("performed"), F.lit(0)).alias("o")).first()
    return {"processed": total.p, "performed": total.o}
