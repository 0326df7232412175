"""Language identification by nearest centroid.

A text is a vector of hashed byte trigrams (ASCII in lower case, everything but letters a space), 1 + log(count) times
the inverse document frequency, normalised to length 1. Each language has several centroids, found by spherical
k-means, since one language has several kinds of text. The language of the nearest centroid by cosine is predicted.
A text is rejected when its cosine is far below that of nearly all of its language's own training texts. Cosines of texts
under 100 trigrams are low by nature and are compared after division by the square root of length / 100.

Document frequencies and the number of texts of a language cover all training rows; the clustering takes a sample of
about `sample` different rows (drawn by a hash of id and text, each language in equal parts), so it needs the same memory at
any size. The driver gets a few numbers for each language and centroid.

Defined results: null texts and texts without a letter have the language `und`, score 0 and are rejected; with no
training rows every language is `und`; rows with a null language are predicted but not learned from; repeated rows
count as often as they occur, but once in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Workspace, small_batches
from .words import Texts, slices

UNKNOWN = "und"

#: Letters keep their (lower-case) byte; all else, and so every run of it, is a space.
_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(texts: Texts, bits: int) -> np.ndarray:
    """Counts of hashed byte trigrams: one row per text, 2 ** bits columns."""
    b = _LETTER[texts.data].astype(np.uint32)
    n, rows = len(b), len(texts.valid)
    if n < 3:
        return np.zeros((rows, 1 << bits), np.float32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h = (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)
    row = np.repeat(np.arange(rows), np.diff(texts.offsets))
    use = (row[:-2] == row[2:]) & (b[1:-1] != 32)
    return np.bincount(row[:-2][use] << bits | h[use], minlength=rows << bits).reshape(rows, -1).astype(np.float32)


def with_letter(texts: Texts) -> np.ndarray:
    """Whether each text has a letter. Only texts without ASCII letters are looked at character by character."""
    count = lambda on: np.diff(np.append(0, np.cumsum(on))[texts.offsets])
    some = count((texts.data | 32) - np.uint8(97) < 26) > 0
    for i in np.flatnonzero(~some & (count(texts.data >= 128) > 0)):
        some[i] = any(map(str.isalpha, texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return some


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1; a row without trigrams stays zero."""
    x = counts
    on = x > 0
    x[on] = 1 + np.log(x[on])
    x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(norm, 1e-12)


def _by_length(length: np.ndarray) -> np.ndarray:
    """What cosines of texts of so many trigrams are divided by."""
    return np.sqrt(np.minimum(1, length / 100))


@dataclass(frozen=True)
class LanguageId:
    """bits: log2 of hashed trigrams. centroids: of each language. sample: rows for clustering. far: a text is rejected
    whose cosine is below that share of the lower quantile of its language's training cosines."""

    bits: int = 12
    centroids: int = 4
    sample: int = 3000
    quantile: float = 0.01
    far: float = 0.3
    seed: int = 11

    def fit(self, train: DataFrame) -> LanguageModel:
        """train has doc_id, text and lang."""
        size, width = 1 << self.bits, self.bits
        rows = train.filter("text is not null and lang is not null").select(F.col("doc_id").cast("string").alias("key"), "text", "lang")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, n = np.zeros(size, np.int64), 0
            for batch in batches:
                for _, _, texts in slices(batch.column(0), rows=250):
                    df += (trigrams(texts, width) > 0).sum(axis=0)
                    n += len(texts.valid)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(size), -1)), pa.array(np.append(df, n))], ["gram", "n"])

        with small_batches(train.sparkSession):
            found = dict(rows.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect())
        total = found.pop(-1, 0)
        df = np.zeros(size)
        df[list(found)] = list(found.values())
        idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(0.1)

        of_lang = dict(rows.groupBy("lang").count().collect())
        if not of_lang:
            return LanguageModel(self, idf, [], np.zeros((0, size), np.float32), np.zeros(0))
        share = max(8, self.sample // len(of_lang))
        rates = F.create_map(*(F.lit(x) for k, n in sorted(of_lang.items()) for x in (k, min(1.0, share / n))))
        part = (F.xxhash64("key", "text", F.lit(self.seed)) / F.lit(2.0**64)) + 0.5
        k, quantile, seed = self.centroids, self.quantile, self.seed

        def cluster(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            """Spherical k-means over one language's part of the sample."""
            pdf = pdf.sort_values(["key", "text"], kind="stable")
            counts = np.concatenate([trigrams(t, width) for _, _, t in slices(pa.array(pdf["text"], pa.string()), rows=250)])
            length = counts.sum(axis=1)
            x = vectors(counts, idf)
            c = x[np.random.default_rng(seed).permutation(len(x))[: min(k, len(x))]]
            for _ in range(15):
                near = (x @ c.T).argmax(axis=1)
                c = np.array([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            best = (x @ c.T).max(axis=1)[length > 0] / _by_length(length[length > 0])
            low = float(np.quantile(best, quantile)) if len(best) else 0.0
            return pd.DataFrame({"lang": key[0], "centroid": list(c.astype(np.float32)), "low": low})

        drawn = rows.filter(part < F.coalesce(F.try_element_at(rates, F.col("lang")), F.lit(0.0)))
        drawn = drawn.withColumn("hash", F.xxhash64("text")).dropDuplicates(["lang", "key", "hash"]).select("key", "text", "lang")
        made = drawn.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>, low double")
        made = sorted(made.collect(), key=lambda r: (r.lang, r.low, r.centroid[:8]))
        return LanguageModel(self, idf, [r.lang for r in made], np.array([r.centroid for r in made], np.float32).reshape(-1, size), np.array([r.low for r in made]))


@dataclass(frozen=True)
class LanguageModel:
    options: LanguageId
    idf: np.ndarray
    langs: list
    centroids: np.ndarray
    low: np.ndarray

    def predict(self, docs: DataFrame, keep: list[Column | str], names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
        """The columns of keep, and, so named, the language, its score (cosine of the nearest centroid, 0 to 1), and whether
        the text is rejected."""
        o, idf, c, low, langs = self.options, self.idf, self.centroids, self.low, np.array([*self.langs, UNKNOWN], dtype=object)
        # A text that is kept anyway isn't sent to Python twice.
        chosen = docs.select(*keep) if "text" in [k for k in keep if isinstance(k, str)] else docs.select(*keep, F.col("text").alias("__text"))
        kept = chosen.drop("__text").schema
        n_kept, at = len(kept), chosen.columns.index("text" if "text" in kept.names else "__text")
        out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", {} string, {} double, {} boolean".format(*names)
        columns = [*kept.names, *names]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, end, texts in slices(batch.column(at), rows=250):
                    some = with_letter(texts) & bool(len(c))
                    near, score, limit = np.full(end - start, len(langs) - 1), np.zeros(end - start), np.full(end - start, np.inf)
                    if some.any():
                        counts = trigrams(texts, o.bits)
                        length = counts.sum(axis=1)
                        s = vectors(counts, idf) @ c.T
                        best = s.argmax(axis=1)
                        near = np.where(some, best, near)
                        score = np.where(some, np.clip(s.max(axis=1), 0, 1), 0.0)
                        limit = np.where(some, o.far * low[best] * _by_length(length), np.inf)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, end - start) for i in range(n_kept)), pa.array(langs[near], pa.string()), pa.array(score.astype(np.float64)), pa.array(score < limit)], columns)

        return chosen.mapInArrow(run, out)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves that remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs without those that the model rejects; same columns. Texts go to Python, only verdicts come back: the ids and
    text hashes of rejected rows are a written table, whose known size decides how Spark joins it."""
    named = model.predict(docs, [F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__f")], ("__lang", "__score", "__rejected"))
    gone = Workspace(docs.sparkSession, "language-id").keep(named.filter("__rejected").select("__d", "__f").distinct(), "rejected")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__f")), "left_anti")
