"""Exact substring dedup: bytes covered by a string of `length` bytes that also starts elsewhere.

This is prefix doubling over text positions, distributed: positions are ranked by the strings that begin there, strings
grow from round to round, Spark groups positions by (rank so far, what the growth adds), and positions leave as soon as
they are unique, or are settled when everything up to the threshold is the same. All positions of a corpus don't fit in a
shuffle, so neighbouring ones go together as long as their strings can tell nothing apart:

1. Every start of a string of `length` bytes is represented by the start's minimizer: the position with the smallest hash of
   8 bytes among the next `window`. Equal strings have equal minimizers, about one for each `window` / 2 starts. All strings
   that a minimizer stands for share the bytes from it to `length - window + 1` further on: its core, the first rank. A
   minimizer whose core is nowhere else is unique, with all its starts.
2. Where all that have a core agree on everything around it that their starts' strings cover (the extent), all these starts
   are repeated. Otherwise the different extents are kept as contexts, and each goes into blocks of `block` neighbouring
   starts, at fixed distances from the minimizer: the strings of a block share a longer core, and are judged alike.
3. What is still undecided, the blocks where texts begin to differ, is taken start by start, by all `length` bytes.

Ranks are hashes of two lanes modulo 2 ** 61 - 1. Rounds count by keys with map-side sums and join the counts back; no group
is collected. The first round's repeated cores are a Bloom filter (at most 32 MB) in the pass that sends minimizers on; the
join behind it is exact. Texts are named by 128 bits, so copies are one text with the same ranges.

Defined results: a null text is empty; a text shorter than `length` loses nothing; repeated rows are copies of one another;
a string that overlaps itself counts as any other; cuts may fall inside a character, so what is left is binary; a text of any
length is read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .tables import Workspace
from .words import Sums, Texts, as_long, mix, slices

_TEXT = ["text_a", "text_b"]
_RANGES = "array<struct<lo:bigint,hi:bigint>>"


def _names(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(1), text).alias("text_b")]


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, first + 1, ... n times for each, and the number of each."""
    each = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n), each


def _binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces data[start:end]."""
    place, _ = _spread(starts, ends - starts)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(0, np.cumsum(ends - starts)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[place]))])


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(as_long(x) if x.dtype == np.uint64 else x) for x in columns.values()], list(columns))


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest runs that ranges lo:hi cover."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
    new = np.append(True, lo[1:] > hi[:-1])[: len(lo)]
    return lo[new], hi[np.append(new[1:], True)[: len(lo)]]


@dataclass(frozen=True)
class RepeatedSpans:
    """length: bytes of a string that counts. window: starts that share a minimizer, at most. block: starts that are judged
    together in the second round. bits: log2 of a filter's most bits."""

    length: int = 200
    window: int = 100
    block: int = 8
    bits: int = 28

    def __post_init__(self):
        if not 1 <= self.block <= self.window <= self.length - 8:
            raise ValueError("block <= window <= length - 8")

    def _minimizers(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, place, and first and last start of each minimizer."""
        n = len(texts.data)
        v = np.zeros(n + 8, np.uint64)
        v[:n] = texts.data
        for k in (1, 2, 4):
            v[:-k] |= v[k:] << np.uint64(8 * k)
        m = (mix(v[:n]) & np.uint64(0xFFFFFFFF << 32)) | np.arange(n, dtype=np.uint64)
        size = 1
        while 2 * size <= self.window:
            m, size = np.minimum(m[: max(len(m) - size, 0)], m[size:]), 2 * size
        if size < self.window:
            m = np.minimum(m[: max(len(m) - self.window + size, 0)], m[self.window - size :])
        starts, row = _spread(texts.offsets[:-1], np.maximum(np.diff(texts.offsets) - self.length + 1, 0))
        at = (m[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1]))[: len(at)]
        first = np.flatnonzero(new)
        return row[first], at[first], starts[first], starts[np.append(first[1:], len(at)) - 1] if len(first) else first

    def _ranked(self, sums: tuple[Sums, Sums], at: np.ndarray, lo: np.ndarray, hi: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Core and extent of the starts lo to hi around at, where near and far are the block's least and greatest distance."""
        core = sums[0](at - near, at - far + self.length)
        return mix(core + near.astype(np.uint64)), mix(sums[1](lo, hi + self.length) ^ mix((at - lo).astype(np.uint64)))

    def _sums(self, data: np.ndarray) -> tuple[Sums, Sums]:
        return Sums.of_bytes(data), Sums.of_bytes(data, 1)

    def _first(self, texts: Texts) -> tuple[np.ndarray, ...]:
        row, at, lo, hi = self._minimizers(texts)
        zero = np.zeros(len(at), np.int64)
        return row, at, lo, hi, *(self._ranked(self._sums(texts.data), at, lo, hi, zero, zero + self.window - 1) if len(at) else (zero.astype(np.uint64),) * 2)

    def _classes(self, rows: DataFrame, n: Column) -> DataFrame:
        """core and mixed of cores that are repeated; mixed: not all that have it agree on the extent."""
        found = rows.groupBy("core").agg(F.sum(n).alias("n"), F.min("extent").alias("low"), F.max("extent").alias("high"))
        return found.filter("n > 1").select("core", (F.col("low") != F.col("high")).alias("mixed"))

    def _all(self, docs: DataFrame) -> DataFrame:
        """core and extent of all minimizers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, texts in slices(batch.column(0)):
                    *_, core, extent = self._first(texts)
                    yield _batch({"core": core, "extent": extent})

        return docs.select("text").mapInArrow(run, "core long, extent long")

    def _repeated(self, docs: DataFrame, on: np.ndarray, mixed: np.ndarray) -> DataFrame:
        """Minimizers that the filter lets through: text, core, extent, first and last start (in the text), mark (the
        distance from the first start) and, where cores may be mixed, the context: all bytes of the starts' strings."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, _, texts in slices(batch.column(2)):
                    found = self._first(texts)
                    row, at, lo, hi, core, extent = (x[bloom.known(on, found[4])] for x in found)
                    some = np.zeros(len(core), bool)
                    some[bloom.known(mixed, core)] = True
                    context = _binary(texts.data, lo, np.where(some, hi + self.length, lo))
                    a, b = (batch.column(i).take(pa.array(row + begin)) for i in (0, 1))
                    base = texts.offsets[row]
                    yield _batch({"text_a": a, "text_b": b, "core": core, "extent": extent, "lo": lo - base, "hi": hi - base, "mark": at - lo, "context": context})

        return docs.select(*_names("text"), "text").mapInArrow(run, "text_a long, text_b long, core long, extent long, lo long, hi long, mark long, context binary")

    def _each(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The contexts' bytes, where each begins, and its mark there."""
        context = batch.column("context")
        offsets = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + len(context) + 1].astype(np.int64)
        data = np.frombuffer(context.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        begin = offsets[:-1] - offsets[0]
        return data, begin, begin + batch.column("mark").to_numpy()

    def _blocks(self, contexts: DataFrame) -> DataFrame:
        """ref, n, core, extent, from and to (starts in the context) of each context's blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k in range(0, whole.num_rows, 2048):
                    batch = whole.slice(k, 2048)
                    data, begin, at = self._each(batch)
                    last = batch.column("hi").to_numpy() - batch.column("lo").to_numpy()
                    mark = at - begin
                    low, high = (mark - last) // self.block, mark // self.block
                    number, each = _spread(low, high - low + 1)
                    near, far = number * self.block, number * self.block + self.block - 1
                    lo, hi = np.maximum(mark[each] - far, 0), np.minimum(mark[each] - near, last[each])
                    core, extent = self._ranked(self._sums(data), at[each], begin[each] + lo, begin[each] + hi, near, far)
                    take = pa.array(each)
                    yield _batch({"ref": batch.column("ref").take(take), "n": batch.column("n").take(take), "core": core, "extent": extent, "from": lo, "to": hi})

        return contexts.mapInArrow(run, "ref long, n long, core long, extent long, from long, to long")

    def _starts(self, contexts: DataFrame) -> DataFrame:
        """text, n, start and name (a, b) of each start from:to of the contexts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k in range(0, whole.num_rows, 2048):
                    batch = whole.slice(k, 2048)
                    data, begin, _ = self._each(batch)
                    first, last = (batch.column(c).to_numpy() for c in ("from", "to"))
                    place, each = _spread(first, last - first + 1)
                    sums, at, take = self._sums(data), begin[each] + place, pa.array(each)
                    a, b = (s(at, at + self.length) for s in sums)
                    yield _batch({**{c: batch.column(c).take(take) for c in (*_TEXT, "n")}, "start": batch.column("lo").to_numpy()[each] + place, "a": a, "b": b})

        return contexts.mapInArrow(run, "text_a long, text_b long, n long, start long, a long, b long")

    def ranges(self, docs: DataFrame, work: Workspace) -> DataFrame:
        """text_a, text_b and ranges (lo to hi) of starts of repeated strings, of each different text that has any."""
        cores = work.keep(self._classes(self._all(docs), F.lit(1)), "cores")
        token = F.col("core").alias("token")
        filters = bloom.build(cores.select(token), self.bits), bloom.build(cores.filter("mixed").select(token), self.bits)
        kept = work.keep(self._repeated(docs, *filters), "rows")
        rows = kept.join(cores, "core")
        found = [rows.filter("not mixed").select(*_TEXT, "lo", "hi")]

        # Grouped before they are joined, so that a very common core is combined where its rows are.
        one = F.first(F.struct(*_TEXT, "lo", "hi", "mark", "context")).alias("x")
        contexts = kept.filter("octet_length(context) > 0").groupBy("core", "extent").agg(F.count("*").alias("n"), one)
        contexts = contexts.join(cores.filter("mixed").select("core"), "core", "left_semi")
        contexts = work.keep(contexts.select(F.monotonically_increasing_id().alias("ref"), "core", "extent", "n", "x.*"), "contexts")
        several = contexts.filter("n > 1").select("core", "extent")
        found.append(rows.filter("mixed").join(several, ["core", "extent"], "left_semi").select(*_TEXT, "lo", "hi"))

        blocks = work.keep(self._blocks(contexts.select("ref", "n", "lo", "hi", "mark", "context")), "blocks")
        judged = work.keep(blocks.join(self._classes(blocks, F.col("n")), "core").select("ref", "n", "from", "to", "mixed"), "judged")
        texts = contexts.select("ref", *_TEXT, "lo")
        settled = judged.filter("n = 1 and not mixed").join(texts, "ref")
        found.append(settled.select(*_TEXT, (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi")))

        open_ = judged.filter("mixed").select("ref", "from", "to").join(contexts, "ref")
        starts = work.keep(self._starts(open_.select(*_TEXT, "n", "lo", "from", "to", "mark", "context")), "starts")
        twice = starts.groupBy("a", "b").agg(F.sum("n").alias("c")).filter("c > 1").select("a", "b")
        found.append(starts.filter("n = 1").join(twice, ["a", "b"], "left_semi").select(*_TEXT, F.col("start").alias("lo"), F.col("start").alias("hi")))
        ranges = reduce(DataFrame.unionByName, found).distinct().groupBy(*_TEXT).agg(F.collect_list(F.struct("lo", "hi")).cast(_RANGES).alias("ranges"))
        ranges = work.keep(ranges, "ranges")
        for name in ("cores", "rows", "contexts", "blocks", "judged", "starts"):
            work.drop(name)  # the ranges are written
        return ranges

    def cut(self, docs: DataFrame, columns: list[str], digest: bool = False) -> DataFrame:
        """The given columns, n_bytes, spans (start and end of each longest run of removed bytes) and kept, the bytes that are
        left; with digest, the SHA-256 of these instead, and only texts that lose something are shuffled for it."""
        work, length = Workspace(docs.sparkSession, "repeated-spans"), self.length
        ranges = self.ranges(docs, work)
        on = bloom.build(ranges.select(F.col("text_a").alias("token")), self.bits) if digest else None
        given = docs.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(columns)), *_names("text"), F.col("text").cast("binary").alias("__text"))
        types = {f"__{i}": docs.schema[c].dataType.simpleString() for i, c in enumerate(columns)}
        head = ", ".join(f"{c} {t}" for c, t in types.items())
        out = lambda x: hashlib.sha256(x).hexdigest() if digest else x

        def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Texts without ranges are done here."""
            for batch in small(batches):
                names = batch.column("text_a").to_numpy().view(np.uint64)
                kept = np.zeros(batch.num_rows, bool)
                kept[bloom.known(on, names)] = True
                text = [x or b"" for x in batch.column("__text").to_pylist()]
                done = [None if k else out(x) for k, x in zip(kept.tolist(), text, strict=True)]
                columns = [*batch.columns[:-1], pa.array([len(x) for x in text], pa.int64()), pa.array([x if k else None for k, x in zip(kept.tolist(), text, strict=True)], pa.binary()), pa.array(done, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "__n", "__text", "__done"])

        if digest:
            given = given.mapInArrow(whole, f"{head}, text_a long, text_b long, __n long, __text binary, __done string")
        else:
            given = given.withColumns({"__n": F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long"), "__done": F.lit(None).cast("string")})

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                spans, kept = [], []
                ranges = batch.column("ranges")
                bounds = np.append(ranges.offsets.to_numpy(), 0) if len(ranges) else np.zeros(1, int)
                lo, hi = (ranges.values.field(i).to_numpy() for i in (0, 1))
                some = ranges.is_valid().to_pylist()
                for i, (text, done) in enumerate(zip(batch.column("__text").to_pylist(), batch.column("__done").to_pylist(), strict=True)):
                    s, e = _merged(lo[bounds[i] : bounds[i + 1]], hi[bounds[i] : bounds[i + 1]] + length) if some[i] else ((), ())
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)])
                    if done is None:
                        text, at, rest = text or b"", 0, []
                        for a, b in zip(s, e, strict=True):
                            rest.append(text[at:a])
                            at = b
                        done = out(b"".join([*rest, text[at:]]))
                    kept.append(done)
                struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in types), batch.column("__n"), pa.array(spans, struct), pa.array(kept, pa.string() if digest else pa.binary())], [*types, "n_bytes", "spans", "kept"])

        joined = given.join(ranges, _TEXT, "left").select(*types, "__n", "__text", "__done", "ranges")
        cut_ = joined.mapInArrow(cut, f"{head}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept {'string' if digest else 'binary'}")
        return cut_.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(columns)), "n_bytes", "spans", "kept")


#: What op13 returns, for DuckDB, over the documents' bytes in hexadecimal digits; strings are cut out of pieces of 1,000 starts.
SQL = """WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, 1000 * j AS base, substr(x, 2000 * j + 1, 2398) AS y FROM (SELECT r, x, unnest(range(length(x) // 2000 + 1)) AS j FROM d)),
w AS (SELECT r, base + i AS i, md5(substr(y, 2 * i + 1, 400)) AS m FROM (SELECT r, base, y, unnest(range(length(y) // 2 - 199)) AS i FROM p)),
t AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN t USING (m)),
h AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM g),
s AS (SELECT r, span, min(i) AS a, max(i) + 200 AS b FROM h GROUP BY ALL),
k AS (SELECT r, substr(x, 2 * lag(b, 1, 0) OVER o + 1, 2 * (a - lag(b, 1, 0) OVER o)) AS before, a, b, x FROM s JOIN d USING (r) WINDOW o AS (PARTITION BY r ORDER BY a)),
z AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(before, '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM k GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN z USING (r)"""
