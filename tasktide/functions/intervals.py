"""Durations and schedules: small driver-side values; nothing here touches rows."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of each accepted unit.
UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
_PART = re.compile(r"\s*(\d+(?:\.\d+)?)\s*(ms|[smhdw])")


def duration_ms(value: int | float | str) -> int:
    """Milliseconds of a number of milliseconds or a sum such as "5m 20s"; ValueError for anything else or below 0."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise ValueError(f"invalid interval: {value!r}")
    if isinstance(value, str):
        parts, at, total = 0, 0, 0.0
        while m := _PART.match(value, at):
            total += float(m[1]) * UNITS[m[2]]
            at, parts = m.end(), parts + 1
        if not parts or value[at:].strip():
            raise ValueError(f"invalid interval: {value!r}")
        return int(total)
    if not math.isfinite(value) or value < 0:
        raise ValueError(f"an interval has to be finite and not negative: {value!r}")
    return int(value)


def plus_ms(at: Column, ms: Column | int) -> Column:
    """A timestamp without time zone, moved on by milliseconds."""
    ms = ms if isinstance(ms, Column) else F.lit(ms)
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms / 1000).cast("decimal(18,6)"))


def ms_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


#: (name, least, greatest) of cron's fields; a sixth field in front gives seconds.
_FIELDS = (("second", 0, 59), ("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
_NAMES = {n: i + 1 for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_DAYS = {n: i for i, n in enumerate("sun mon tue wed thu fri sat".split())}


class Cron:
    """A cron expression of five fields, or six with seconds. As usual, where both day fields are restricted either may
    match."""

    def __init__(self, expression: str, tz: str = "UTC"):
        fields = expression.split()
        if len(fields) not in (5, 6):
            raise ValueError(f"invalid interval: cron expression {expression!r}")
        fields = fields if len(fields) == 6 else ["0", *fields]
        self.tz = ZoneInfo(tz)
        self.allowed = [self._field(f, *limits) for f, limits in zip(fields, _FIELDS, strict=True)]
        self.allowed[5] = {d % 7 for d in self.allowed[5]}
        self.any_hour, self.any_day, self.any_weekday = fields[2] in "*?", fields[3] in "*?", fields[5] in "*?"

    @staticmethod
    def _field(text: str, name: str, low: int, high: int) -> set[int]:
        known = _NAMES if name == "month" else _DAYS if name == "weekday" else {}
        number = lambda x: known[x.lower()] if x.lower() in known else int(x)
        out: set[int] = set()
        try:
            for part in text.split(","):
                span, _, step = part.partition("/")
                first, dash, last = span.partition("-")
                a, b = (low, high) if span in ("*", "?") else (number(first), number(last) if dash else high if step else number(first))
                every = int(step) if step else 1
                if not (low <= a <= b <= high and every > 0):
                    raise ValueError
                out |= set(range(a, b + 1, every))
        except ValueError:
            raise ValueError(f"invalid interval: cron field {text!r}") from None
        return out

    def _step(self, t: datetime) -> timedelta | None:
        """How far on the next wall-clock time worth a look is; None if t matches."""
        second, minute, hour, day, month, weekday = self.allowed
        of_day, of_week = t.day in day, (t.isoweekday() % 7) in weekday
        right = (of_day or self.any_day) and (of_week or self.any_weekday) if self.any_day or self.any_weekday else of_day or of_week
        if t.month not in month or not right:
            return t.replace(hour=0, minute=0, second=0) + timedelta(days=1) - t
        if t.hour not in hour:
            return timedelta(hours=1) - timedelta(minutes=t.minute, seconds=t.second)
        if t.minute not in minute:
            return timedelta(minutes=1) - timedelta(seconds=t.second)
        return None if t.second in second else timedelta(seconds=1)

    def next(self, after: datetime) -> datetime:
        """The first matching second behind `after` (both UTC, without time zone).

        Where clocks go back, a schedule for any hour goes through the repeated hour twice, one with given hours once; where
        they go forward, a time that is left out comes as much later as the clock jumps."""
        utc = ZoneInfo("UTC")
        start = (after.replace(microsecond=0) + timedelta(seconds=1)).replace(tzinfo=utc)
        found, t = [], start.astimezone(self.tz).replace(tzinfo=None, fold=0)
        limit = t.year + 5
        while t.year <= limit and (step := self._step(t)) is not None:  # by the clock on the wall
            t += step
        at = t.replace(tzinfo=self.tz).astimezone(utc)
        if t.year <= limit and at >= start:
            found.append(at)
        while start.year <= limit and (not found or start < found[0]):  # by time that passes: sees repeated hours
            local = start.astimezone(self.tz)
            step = self._step(local.replace(tzinfo=None, fold=0))
            if step is None and (self.any_hour or not local.fold):
                found.append(start)
                break
            # Not more than an hour at once, as the clock may jump.
            start += min(step or timedelta(seconds=1), timedelta(hours=1) - timedelta(minutes=local.minute, seconds=local.second))
        if not found:
            raise ValueError("the cron expression has no next time")
        return min(found).replace(tzinfo=None)


def interval_function(interval: int | float | str | Callable[[datetime], datetime | int], tz: str = "UTC") -> Callable[[datetime], datetime]:
    """From a time to the next one: a duration, "CRON " and an expression, or a function that gives a time or milliseconds."""
    if callable(interval):

        def call(at: datetime) -> datetime:
            value = interval(at)
            return value if isinstance(value, datetime) else at + timedelta(milliseconds=duration_ms(value))

        return call
    if isinstance(interval, str) and interval[:5].lower() == "cron ":
        return Cron(interval[5:], tz).next
    ms = duration_ms(interval)
    return lambda at: at + timedelta(milliseconds=ms)
