"""Runs of words that repeat with a period, by divide and conquer.

A text's words are interned as ids, by their bytes. A stretch of words is halved at its midpoint; for every period q, two
Z-functions of the right half and of the left half, each read from the midpoint in both directions, give the repetition of
period q that crosses it: how far the words behind the midpoint agree with those q further on, how far those before it do,
and the same for those q further back. A repetition that lies in a half is found when that half is halved. What reaches
the end of a stretch and would go on beyond it is found whole where a longer stretch is halved, so it is left out here.
Of equal intervals the smallest period stays: a longer one is a multiple.

All stretches of one depth, of all texts of a slice, are worked on at once: a Z-function is an array whose values mostly
end at the first word; the few that go on are extended word by word, then by halved steps over hashes of word runs. Runs
that are found are compared word by word; if one of them isn't what its hashes say, the slice is done without hashes.

Defined results: a null text is empty; a text without words has no runs and an empty rest; a run has at least `least`
words and `times` periods, and no neighbouring word goes on with its period; repeated rows get equal results; a text of any
length is one row, worked on as a whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import NOT_SPACE, Sums, Texts, mix, slices

_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Words that a Z-value is extended by one at a time before hashes are used.
_STEPS = 16


class _Ids:
    """Interned words of some rows; row i has the words first[i]:first[i + 1]."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, hashed: bool = True):
        self.ids, self.first, self.hashed, self._sums = ids, first, hashed, None

    def _same(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        if self._sums is None:
            self._sums = Sums.of(mix(self.ids.astype(np.uint64) + np.uint64(1)))
        return self._sums(a, a + n) == self._sums(b, b + n)

    def common(self, a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
        """How many words from places a on, forwards or backwards, are those from places b on; at most room."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(room > 0)
        live = live[self.ids[a[live]] == self.ids[b[live]]]
        while len(live):
            out[live] += 1
            at = out[live]
            if self.hashed and at[0] >= _STEPS:
                break
            more = room[live] > at
            live, at = live[more], at[more] * step
            live = live[self.ids[a[live] + at] == self.ids[b[live] + at]]
        if len(live):
            for k in reversed(range(int(room[live].max()).bit_length())):
                at = out[live]
                x = live[at + (1 << k) <= room[live]]
                at = out[x] if step > 0 else -out[x] - (1 << k) + 1
                out[x[self._same(a[x] + at, b[x] + at, 1 << k)]] += 1 << k
        return out

    def runs(self, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and period of all runs, in order of start and period."""
        found = []
        lo, hi = self.first[:-1], self.first[1:]
        begin, stop = lo, hi  # of the row
        while True:
            use = hi - lo >= least
            lo, hi, begin, stop = lo[use], hi[use], begin[use], stop[use]
            if not len(lo):
                break
            mid = (lo + hi) // 2
            most = (hi - lo) // times
            node = np.repeat(np.arange(len(lo)), most)
            q = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
            l, m, h = lo[node], mid[node], hi[node]
            for start, end in (
                (m - self.common(m - 1, m + q - 1, m - l, -1), m + q + self.common(m, m + q, h - m - q, 1)),
                (m - q - self.common(m - q - 1, m - 1, m - q - l, -1), m + self.common(m - q, m, h - m, 1)),
            ):
                use = np.flatnonzero((start >= l) & (end <= h) & (end - start >= np.maximum(least, times * q)))
                s, e, p, b, z = start[use], end[use], q[use], begin[node[use]], stop[node[use]]
                further = ((s > b) & (self.ids[s - 1] == self.ids[s - 1 + p])) | ((e < z) & (self.ids[np.minimum(e, len(self.ids) - 1)] == self.ids[e - p]))
                found.append(np.stack([s, e, p])[:, ~further])
            lo, hi, begin, stop = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.tile(begin, 2), np.tile(stop, 2)
        start, end, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[new], end[new], period[new]
        order = np.lexsort((period, start))
        start, end, period = start[order], end[order], period[order]
        n = end - start - period
        place = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        if (self.ids[place] != self.ids[place + np.repeat(period, n)]).any():
            return _Ids(self.ids, self.first, hashed=False).runs(least, times)
        return start, end, period


def _interned(texts: Texts) -> tuple[_Ids, np.ndarray, np.ndarray]:
    """The words' ids, and where each begins and ends."""
    s, e = texts.spans(NOT_SPACE)
    ends = np.append(0, np.cumsum(e - s))
    words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(texts.data[NOT_SPACE[texts.data]])])
    return _Ids(words.dictionary_encode().indices.to_numpy().astype(np.int64), np.searchsorted(s, texts.offsets)), s, e


def _joined(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words s:e, with a space between two of a row, and where each row's end."""
    n = e - s + 1
    ends = np.cumsum(n)
    data = np.append(data, np.uint8(32))
    out = data[np.arange(n.sum()) + np.repeat(s - (ends - n), n)]
    out[ends - 1] = 32
    some = np.diff(first) > 0
    keep = np.ones(len(out), bool)
    keep[ends[first[1:][some] - 1] - 1] = False
    return out[keep], np.cumsum(np.append(0, ends)[first[1:]] - np.append(0, ends)[first[:-1]] - some)


@dataclass(frozen=True)
class PeriodicRuns:
    """least: words of a run. times: periods of a run."""

    least: int = 24
    times: int = 3

    def collapse(self, docs: DataFrame, columns: list[str | Column], text: str = "text") -> DataFrame:
        """The given columns, n_words, runs (start, length and period in words, by start and then period), and collapsed: the
        text without the words that any run has beyond its first period, words joined by one space."""
        least, times = self.least, self.times
        given = docs.select(*columns, F.col(text).alias("__text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, end, texts in slices(batch.column(batch.num_columns - 1)):
                    words, s, e = _interned(texts)
                    first = words.first
                    start, stop, period = words.runs(least, times)
                    row = np.searchsorted(first, start, "right") - 1
                    change = np.zeros(len(s) + 1, np.int64)
                    np.add.at(change, start + period, 1)
                    np.add.at(change, stop, -1)
                    kept = np.cumsum(change[:-1]) == 0
                    rest, ends = _joined(texts.data, s[kept], e[kept], np.append(0, np.cumsum(kept))[first])
                    each = pa.StructArray.from_arrays([pa.array(x) for x in (start - first[row], stop - start, period)], ["start", "length", "period"])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=end - begin))).astype(np.int32)), each)
                    collapsed = pa.Array.from_buffers(pa.large_string(), end - begin, [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(rest)])
                    out = [*(batch.column(i).slice(begin, end - begin) for i in range(batch.num_columns - 1)), pa.array(np.diff(first)), lists, collapsed.cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

        named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
        return given.mapInArrow(run, f"{named}, n_words long, runs {_RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; texts of a tenth of the documents repeat a part of themselves to the end: from word a on, word i
    becomes word a + (i - a) % p, where the checksum of the doc_id sets a and p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(F.col("h") / 10), F.size("words").cast("long")
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumns({"n": n, "a": F.pmod(g, F.greatest(n, F.lit(1))), "g": g})
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    part = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    rest = F.flatten(F.array_repeat(part, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    words = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(rest, F.lit(1), (F.col("n") - F.col("a")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def digests(collapsed: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the rest."""
    first = F.aggregate("runs", F.lit(None).cast(_RUNS[6:-1]), lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    rows = collapsed.withColumn("best", first)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(F.array_join(lines, "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
