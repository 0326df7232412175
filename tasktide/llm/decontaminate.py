"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of `window` consecutive words (an item of fewer words is one window). A window is
the set of its word shingles with their places. All shingles are ordered by rarity, that is, by the number of documents
that hold them. To contain a window whole, a document must hold every shingle of it, so the necessary prefix of the
ordered set is its first, rarest shingle; a window whose rarest shingle is in no document is out at once. Documents join
windows on that token alone; the token's place bounds the window's start and end, which must lie inside the document;
then the words of exactly that window-sized part of the document are compared with the window's.

Two passes read the documents, one to count the benchmark's shingles and one for candidates. Each carries a Bloom filter as
a first test, whose size follows the benchmark's up to a bound; tables are joined on the shingles themselves. A window that
many items share is compared once; windows of the same items name these by one number, and documents with the same numbers
share one list of items. Windows of one token are one row, so a passage that many documents share makes a few rows for each
of them and no pairs. Words are compared as 64-bit hashes.

Defined results: null or wordless texts have no words and no hits; null or wordless items no windows; items that repeat
an item_id are one item; rows that repeat doc_id and text get equal results; a null item_id counts as an item named by
the empty string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .bloom import known as _known
from .tables import Workspace
from .words import ALNUM, Words, as_long, slices

_SPAN = "array<struct<start:bigint,end:bigint,items:bigint>>"


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


@dataclass(frozen=True)
class Decontamination:
    """window: words of a window. shingle: words of a shingle. bits: log2 of a filter's most bits (32 MB; up to 16 million
    shingles have 16 each, beyond that more words pass the filter, which costs time only). share: a document is contaminated
    when its hit words times `share` are at least its words."""

    window: int = 13
    shingle: int = 4
    bits: int = 28
    share: int = 20

    def windows(self, benchmark: DataFrame) -> DataFrame:
        """item, words (hashes), shingles (hashes in order) and window (a name of the words) of each window of each item."""
        most, k = self.window, self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column(0).to_pylist()
                for start, _, texts in slices(batch.column(1)):
                    words = texts.lower().words(ALNUM)
                    item, parts, tokens = [], [], []
                    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                        h = words.hash[a:b]
                        if not len(h):
                            continue
                        n, m = min(most, len(h)), min(k, len(h))
                        grams = as_long(Words(h, np.array([0, len(h)])).windows(m)[0])
                        for s in range(len(h) - n + 1):
                            item.append(names[start + i] or "")
                            parts.append(as_long(h[s : s + n]))
                            tokens.append(grams[s : s + n - m + 1])
                    long_lists = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(parts, long_lists), pa.array(tokens, long_lists)], ["item", "words", "shingles"])

        return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item string, words array<long>, shingles array<long>").distinct().withColumn("window", F.xxhash64("words"))

    def _filter(self, tokens: DataFrame) -> np.ndarray:
        return bloom.build(tokens, self.bits)

    def _counts(self, docs: DataFrame, on: np.ndarray, sizes: list[int]) -> DataFrame:
        """token and n: parts of the number of documents that hold each shingle which the filter lets through."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, texts in slices(batch.column(0)):
                    words = texts.lower().words(ALNUM)
                    row = np.repeat(np.arange(len(texts.valid)), np.diff(words.first))
                    for k in sizes:
                        h, at = words.windows(k)
                        use = _known(on, h)
                        h, r = h[use], row[at[use]]
                        order = np.lexsort((r, h))
                        h, r = h[order], r[order]
                        new = np.ones(len(h), bool)
                        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                        token, n = np.unique(h[new], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(as_long(token)), pa.array(n.astype(np.int64))], ["token", "n"])

        return docs.select("text").mapInArrow(run, "token long, n long")

    def _candidates(self, docs: DataFrame, on: np.ndarray, sizes: list[int]) -> DataFrame:
        """doc_id, fingerprint, n_words and, for each shingle which the filter lets through, token, at (its first word)
        and near: the words from window - 1 before to window - 1 behind, 0 beyond the text."""
        side = self.window - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, end, texts in slices(batch.column(2)):
                    words = texts.lower().words(ALNUM)
                    n = np.diff(words.first)
                    row = np.repeat(np.arange(end - start), n)
                    found = []
                    for k in sizes:
                        h, at = words.windows(k)
                        use = _known(on, h)
                        found.append((h[use], at[use]))
                    token, at = (np.concatenate(x) for x in zip(*found, strict=True))
                    order = np.argsort(at, kind="stable")
                    token, at = token[order], at[order]
                    r = row[at]
                    place = at[:, None] + np.arange(-side, side + 1)
                    inside = (place >= words.first[r][:, None]) & (place < words.first[r + 1][:, None])
                    near = np.where(inside, words.hash[np.clip(place, 0, max(len(words.hash) - 1, 0))], 0) if len(at) else np.zeros((0, 2 * side + 1), np.uint64)
                    near = _lists(np.full(len(at), 2 * side + 1), pa.array(as_long(near.astype(np.uint64).reshape(-1))))
                    items = pa.StructArray.from_arrays([pa.array(as_long(token)), pa.array(at - words.first[r]), near], ["token", "at", "near"])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start), pa.array(n.astype(np.int64)), _lists(np.bincount(r, minlength=end - start), items)], ["doc_id", "fingerprint", "n_words", "found"])

        rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("fingerprint"), "text")
        return rows.mapInArrow(run, "doc_id long, fingerprint long, n_words long, found array<struct<token:bigint,at:bigint,near:array<bigint>>>")

    def hits(self, docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One row per row of docs: doc_id, fingerprint, n_words and spans (start, end, items): every window found. And
        the items behind each of these numbers: items, item."""
        work = Workspace(docs.sparkSession, "decontaminate")
        of_items = work.keep(self.windows(benchmark), "windows")
        each_item = F.xxhash64("item").cast("decimal(38,0)")
        named = of_items.groupBy("window").agg(F.xxhash64(F.sum(each_item), F.count("*"), F.min("item"), F.max("item")).alias("items"))
        of_number = named.groupBy("items").agg(F.min("window").alias("window")).join(of_items.select("window", "item"), "window").select("items", "item")
        windows = of_items.select("window", "words", "shingles").distinct().join(named, "window")
        sizes = sorted(r.k for r in windows.select(F.least(F.size("words"), F.lit(self.shingle)).alias("k")).distinct().collect())
        sizes = sizes or [self.shingle]
        grams = windows.select(F.explode("shingles").alias("token")).distinct()
        counts = self._counts(docs, self._filter(grams), sizes).join(grams, "token", "left_semi").groupBy("token").agg(F.sum("n").alias("n"))
        ranked = windows.select("items", "words", F.posexplode("shingles").alias("offset", "token")).join(counts, "token", "left")
        first = ranked.groupBy("items", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("x")).filter("x.n > 0")
        prefix = first.groupBy(F.col("x.token").alias("token")).agg(F.collect_list(F.struct(F.col("x.offset").cast("long").alias("offset"), "words", "items")).alias("windows"))
        prefix = work.keep(prefix, "prefix")
        rows = work.keep(self._candidates(docs, self._filter(prefix), sizes), "rows")

        side = self.window - 1
        each = rows.select("doc_id", "fingerprint", "n_words", F.explode("found").alias("x")).select("doc_id", "fingerprint", "n_words", "x.*").distinct()
        start, size = lambda w: F.col("at") - w["offset"], lambda w: F.size(w["words"])
        fits = lambda w: (start(w) >= 0) & (start(w) + size(w) <= F.col("n_words"))
        same = lambda w: F.slice("near", (F.lit(side + 1) - w["offset"]).cast("int"), size(w)) == w["words"]
        found = F.transform(F.filter("windows", lambda w: fits(w) & same(w)), lambda w: F.struct(start(w).alias("start"), (start(w) + size(w)).alias("end"), w["items"].alias("items")))
        spans = each.join(prefix, "token").select("doc_id", "fingerprint", found.cast(_SPAN).alias("spans")).filter(F.size("spans") > 0)
        spans = spans.groupBy(F.col("doc_id").alias("d"), F.col("fingerprint").alias("f")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        spans = work.keep(spans, "spans")
        none = F.array().cast(_SPAN)
        with_any = rows.filter(F.size("found") > 0).join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fingerprint") == F.col("f")), "left")
        out = with_any.select("doc_id", "fingerprint", "n_words", F.coalesce("spans", none).alias("spans"))
        out = out.unionByName(rows.filter(F.size("found") == 0).select("doc_id", "fingerprint", "n_words", none.alias("spans")))
        result = work.keep(out, "hits"), work.keep(of_number, "items")
        for name in ("windows", "prefix", "rows", "spans"):
            work.drop(name)  # the result reads none of them
        return result

    def judged(self, docs: DataFrame, benchmark: DataFrame, of_items: Callable[[Column], dict[str, Column]] = lambda items: {"items": items}) -> DataFrame:
        """doc_id, fingerprint, n_words, n_hit (words inside any span), items (sorted), contaminated. of_items gives other
        columns than items, made once for each different list of items."""
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
        step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], a["to"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to"))
        judged = ["doc_id", "fingerprint", "n_words", F.aggregate("spans", zero, step)["n"].alias("n_hit")]
        columns, none = of_items(F.col("items")), of_items(F.array().cast("array<string>"))
        found, of_number = self.hits(docs, benchmark)
        if columns:
            found = found.withColumn("numbers", F.array_sort(F.array_distinct(F.transform("spans", lambda x: x["items"]))))
            found = found.withColumns({"a": F.when(F.size("numbers") > 0, F.xxhash64("numbers")), "b": F.xxhash64(F.lit(1), "numbers")})
            # Documents that share a passage share a list, which is made once. Written, so that Spark knows the lists' size:
            # small ones are broadcast, and very many documents of one list are split.
            lists = found.filter("a is not null").dropDuplicates(["a", "b"]).select("a", "b", F.explode("numbers").alias("items"))
            lists = lists.join(of_number, "items").groupBy("a", "b").agg(F.array_sort(F.collect_set("item")).alias("items"))
            lists = Workspace(docs.sparkSession, "decontaminate").keep(lists.select("a", "b", *(c.alias(f"__{name}") for name, c in columns.items())), "lists")
            hit = found.filter("a is not null").join(lists, ["a", "b"]).select(*judged, *(F.col(f"__{name}").alias(name) for name in columns))
            out = hit.unionByName(found.filter("a is null").select(*judged, *(c.alias(name) for name, c in none.items())))
        else:
            out = found.select(*judged)
        return out.withColumn("contaminated", (F.col("n_hit") > 0) & (self.share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, options: Decontamination = Decontamination()) -> DataFrame:
    """docs without contaminated documents; same columns. The contaminated ones' ids are a written table, so that Spark
    knows its size and sends it to the documents where it is small, not the documents through a shuffle."""
    bad = options.judged(docs, benchmark, lambda items: {}).filter("contaminated").select(F.col("doc_id").alias("__d"), F.col("fingerprint").alias("__f")).distinct()
    bad = Workspace(docs.sparkSession, "decontaminate").keep(bad, "contaminated")
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__f")), "left_anti")
