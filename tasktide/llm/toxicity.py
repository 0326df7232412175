"""Toxicity by a factorization machine over hashed terms.

A document is the set of its words and of their first four, five and six bytes (one stem has many endings), each a
64-bit hash. Its score is the logistic of
bias + sum of w[i] + sum over pairs of <v[i], v[j]>, so that a pair of terms can weigh more, or less, than both alone:
an insult and the mention of a group, say, which additive weights miss. The pair sum is (|sum v|^2 - sum |v|^2) / 2,
linear in the number of terms.

Training takes a sample of at most `sample` labelled rows, chosen by a hash of the id. Of its terms the `terms` with the
largest likelihood ratio between the classes are kept, and the `frequent` most frequent others. Two models are fitted on
four fifths of the rows and compared by their loss on the rest: an additive one, in which an L1 penalty leaves weight only
where a term explains labels that the others don't, and the machine, in which all terms have factors; those of pairs that
explain labels beyond the weights begin with the pairs' eigenvectors, others with small random numbers, and the number of
steps is where the loss on the rest is lowest; it has to be lower than by the same steps without factors, too. The better
one is fitted again on all rows; as the mean of several machines is a machine with all their factors, there are `machines`
of them, from different beginnings. Scores are shifted so that 0.7 is where fewest of the rows held back are misjudged. All
that the driver gets is the chosen terms and, for each sampled row, which of them it has.

Defined results: null and empty texts have no terms and get the score of the bias; rows without a label teach nothing;
with labels of one class or none all scores are the class's share, 0 without labels; repeated rows count as often as
they occur; several labels of one id all count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, as_long, slices

#: Bytes of a word's beginnings that are terms too.
PREFIXES = (4, 5, 6)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(x: np.ndarray, w: np.ndarray, b: float, v: np.ndarray, s: np.ndarray | None = None) -> np.ndarray:
    """A machine's sum for each row; s: x @ v."""
    s = x @ v if s is None else s
    return b + x @ w + (s * s - x @ (v * v)).sum(axis=1) / 2


@dataclass(frozen=True)
class Toxicity:
    """sample: most labelled rows to learn from. terms: chosen by labels; frequent: further ones by frequency, as a term
    that tells nothing alone may tell something with another. factors: length of a term's vector in each of the machines. l1
    chooses terms, l2 (over the number of rows) holds weights and factors. steps, rate: of the descent. begin: size of the
    random numbers that factors begin with. decision: the score from which on callers take a document for toxic; false_cost:
    what a clean document that is taken for toxic counts, in missed ones."""

    sample: int = 20_000
    terms: int = 512
    frequent: int = 128
    factors: int = 4
    l1: float = 5e-4
    l2: float = 0.15
    steps: int = 300
    rate: float = 0.02
    begin: float = 0.02
    machines: int = 3
    decision: float = 0.7
    false_cost: float = 2.0
    seed: int = 5

    def _terms(self, rows: DataFrame) -> DataFrame:
        """label and the distinct terms of each row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, end, texts in slices(batch.column(1)):
                    h, row = texts.lower().terms(ALNUM, PREFIXES)
                    order = np.argsort(row, kind="stable")
                    h, first = h[order], np.searchsorted(row[order], np.arange(end - start + 1))
                    sets = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(pa.array(at), pa.array(as_long(np.concatenate(sets))))], ["label", "terms"])

        return rows.select("label", "text").mapInArrow(run, "label int, terms array<long>")

    def fit(self, docs: DataFrame, labels: DataFrame) -> ToxicityModel:
        """docs has doc_id and text, labels has doc_id and label (0 or 1)."""
        named = labels.filter("doc_id is not null and label is not null").select(F.col("doc_id"), F.col("label").cast("int"))
        total = named.count()
        part = F.xxhash64("doc_id", F.lit(self.seed)) / F.lit(2.0**64) + 0.5
        # Not more rows than the bound of the sample are broadcast.
        chosen = named.filter(part < min(1.0, 0.98 * self.sample / max(total, 1))).orderBy(part, "doc_id", "label").limit(self.sample)
        rows = self._terms(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).persist()
        of = dict(rows.groupBy("label").count().collect())
        n = [of.get(0, 0), of.get(1, 0)]
        if not all(n):
            rows.unpersist()
            share = n[1] / max(sum(n), 1)
            return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, self.machines * self.factors)), np.log(share / (1 - share)) if 0 < share < 1 else (-30.0, 30.0)[n[1] > 0])
        seen = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum(1 - F.col("label")).alias("a"), F.sum("label").alias("b")).filter("a + b >= 3")

        def entropy(x: Column, y: Column, size: int) -> Column:
            """Twice the log likelihood of a term's share of a class against its share of both."""
            p = (x + y) / sum(n)
            return x * F.log((x + 1e-9) / (p * size)) + (size - x) * F.log((size - x + 1e-9) / ((1 - p) * size + 1e-9))

        ratio = entropy(F.col("a"), F.col("b"), n[0]) + entropy(F.col("b"), F.col("a"), n[1])
        chosen = {r.term for r in seen.orderBy(F.desc(ratio), "term").limit(self.terms).collect()}
        often = [r.term for r in seen.orderBy(F.desc(F.col("a") + F.col("b")), "term").limit(self.terms + self.frequent).collect()]
        chosen |= set([t for t in often if t not in chosen][: self.frequent])
        best = np.sort(np.array(sorted(chosen), np.int64).view(np.uint64))
        known = F.array(*(F.lit(int(x)) for x in best.view(np.int64).tolist())) if len(best) else F.array().cast("array<long>")
        got = rows.select("label", F.array_intersect("terms", known).alias("terms")).collect()
        rows.unpersist()
        x = np.zeros((len(got), len(best)), np.float32)
        for i, r in enumerate(got):
            x[i, np.searchsorted(best, np.array(r.terms, np.int64).view(np.uint64))] = 1
        order = np.lexsort((np.array([r.label for r in got]), *(x.T[:64])))
        return self._train(best, x[order], np.array([r.label for r in got], np.float32)[order])

    def _additive(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights and bias by accelerated proximal gradient: L1 chooses the terms with weight, which are then fitted anew
        without its shrinkage."""
        n, k = x.shape
        u = np.ones(k, np.float32)
        for _ in range(20):  # the largest eigenvalue of x'x
            u = x.T @ (x @ u)
            u /= max(float(np.linalg.norm(u)), 1e-9)
        rate = 4 * n / (float(np.linalg.norm(x @ u)) ** 2 + n)
        w, b = np.zeros(k, np.float32), float(np.log(y.mean() / (1 - y.mean())))
        for l1, l2 in ((self.l1, 0.0), (0.0, self.l2 / n)):
            on = (w != 0) | (l1 > 0)
            z, c = w, b
            for i in range(self.steps):
                e = (_logistic(c + x @ z) - y) / n
                new = (z - rate * (x.T @ e)) / (1 + rate * l2) * on
                new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
                new_b = c - rate * float(e.sum())
                z, c = new + i / (i + 3) * (new - w), new_b + i / (i + 3) * (new_b - b)
                w, b = new.astype(np.float32), new_b
        return w, b

    def _interacting(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        """Terms whose presence together explains labels that their weights don't, and factors to begin with: the largest
        eigenvectors of the matrix of these pairs. A pair counts when the labels' sum over rows with both differs from
        what the weights expect by more than chance does among so many pairs."""
        p = _logistic(b + x @ w).astype(np.float32)
        e, var = x.T @ ((y - p)[:, None] * x), x.T @ ((p * (1 - p))[:, None] * x)
        z = np.where(var > 0.5, e / np.sqrt(np.maximum(var, 0.5)), 0)
        np.fill_diagonal(z, 0)
        limit = np.sqrt(2 * np.log(max(len(w) ** 2 / 2, 2))) + 1
        on = np.flatnonzero((np.abs(z) > limit).any(axis=1))
        if not len(on):
            return on, np.zeros((0, self.factors), np.float32)
        pair = np.where(np.abs(z) > limit, e / (var + 1), 0)[np.ix_(on, on)]
        value, vector = np.linalg.eigh(pair.astype(float))
        take = np.argsort(-value)[: self.factors]
        v = np.zeros((len(on), self.factors), np.float32)
        v[:, : len(take)] = vector[:, take] * np.sqrt(np.clip(value[take], 0, None))
        return on, v

    def _descend(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, b: float, v: np.ndarray, steps: int) -> Iterator[tuple[np.ndarray, float, np.ndarray]]:
        """Weights, bias and factors together, after each tenth step of adaptive gradients."""
        n, at = len(y), [w.astype(np.float32), np.array([b], np.float32), v.astype(np.float32)]
        first, second = [np.zeros_like(a) for a in at], [np.zeros_like(a) for a in at]
        for i in range(1, steps + 1):
            w, b, v = at
            s = x @ v
            e = ((_logistic(_sums(x, w, b[0], v, s)) - y) / n).astype(np.float32)
            grad = (x.T @ e + self.l2 / n * w, np.array([e.sum()]), x.T @ (e[:, None] * s) - (x.T @ e)[:, None] * v + self.l2 / n * v)
            for a, g, m, q in zip(at, grad, first, second, strict=True):
                m += 0.1 * (g - m)
                q += 0.001 * (g * g - q)
                a -= self.rate * (m / (1 - 0.9**i)) / (np.sqrt(q / (1 - 0.999**i)) + 1e-8)
            if i % 10 == 0:
                yield at[0].copy(), float(at[1][0]), at[2].copy()

    def _machine(self, x: np.ndarray, y: np.ndarray, additive: tuple[np.ndarray, float], pairs: tuple[np.ndarray, np.ndarray], seed: int, steps: int) -> Iterator[tuple[np.ndarray, float, np.ndarray]]:
        """A machine's weights, bias and factors after each tenth step, from random factors and those of interacting terms,
        where the weights begin with the additive ones."""
        v = np.random.default_rng(seed).normal(0, self.begin, (x.shape[1], self.factors)).astype(np.float32)
        v[pairs[0]] += pairs[1]
        plain = np.zeros(x.shape[1], np.float32), float(np.log(y.mean() / (1 - y.mean())))
        return self._descend(x, y, *(additive if len(pairs[0]) else plain), v, steps)

    def _shift(self, sums: np.ndarray, y: np.ndarray) -> float:
        """What brings the sum at which fewest rows are misjudged to the decision; of several the nearest to an even chance."""
        cuts = np.linspace(-1.5, 1.5, 61)
        cost = [(y[sums < c] > 0).sum() + self.false_cost * (y[sums >= c] <= 0).sum() for c in cuts]
        best = min(range(len(cuts)), key=lambda i: (cost[i], abs(cuts[i])))
        return float(np.log(self.decision / (1 - self.decision)) - cuts[best])

    def _train(self, terms: np.ndarray, x: np.ndarray, y: np.ndarray) -> ToxicityModel:
        """The better of the additive model and the machine, by the loss on a fifth of the rows that is held back (equal rows
        on the same side), fitted on all rows."""
        none = np.zeros((len(terms), self.machines * self.factors))
        back = np.array([crc32(np.packbits(r > 0).tobytes()) % 5 == 0 for r in x])
        if not len(terms) or not len(np.unique(y[back])) == len(np.unique(y[~back])) == 2:
            w, b = self._additive(x, y)
            return ToxicityModel(terms, w.astype(float), none, b)
        inner, outer = np.ascontiguousarray(x[~back]), np.ascontiguousarray(x[back])

        def loss(sums: np.ndarray) -> float:
            p = np.clip(_logistic(sums), 1e-7, 1 - 1e-7)
            return -float(np.mean(np.where(y[back] > 0, np.log(p), np.log(1 - p))))

        w, b = self._additive(inner, y[~back])
        plain = b + outer @ w

        def best_of(way: Iterator[tuple[np.ndarray, float, np.ndarray]]) -> tuple[list[float], np.ndarray]:
            """Losses step by step, until they have not become lower for long, and the sums of the lowest."""
            losses: list[float] = []
            for a in way:
                sums = _sums(outer, *a)
                losses.append(loss(sums))
                best = sums if losses[-1] == min(losses) else best
                if len(losses) - int(np.argmin(losses)) > 8:
                    break
            return losses, best

        pairs = self._interacting(inner, y[~back], w, b)
        losses, best = best_of(self._machine(inner, y[~back], (w, b), pairs, self.seed, self.steps))
        # The same way without factors tells what these are good for.
        alone, _ = best_of(self._descend(inner, y[~back], np.zeros(len(terms)), float(np.log(y[~back].mean() / (1 - y[~back].mean()))), np.zeros((len(terms), 0)), self.steps))
        w, b = self._additive(x, y)
        if min(losses) >= 0.98 * min(loss(plain), *alone):
            return ToxicityModel(terms, w.astype(float), none, b + self._shift(plain, y[back]))
        steps, pairs = 10 * (int(np.argmin(losses)) + 1), self._interacting(x, y, w, b)
        made = [list(self._machine(x, y, (w, b), pairs, self.seed + i, steps))[-1] for i in range(self.machines)]
        w, b = (np.mean([m[i] for m in made], axis=0) for i in (0, 1))
        v = np.concatenate([m[2] for m in made], axis=1) / np.sqrt(self.machines)
        return ToxicityModel(terms, w.astype(float), v.astype(float), float(b) + self._shift(best, y[back]))


@dataclass(frozen=True)
class ToxicityModel:
    terms: np.ndarray
    weight: np.ndarray
    factors: np.ndarray
    bias: float

    def score(self, docs: DataFrame, keep: list[Column | str]) -> DataFrame:
        """The columns of keep, and score (0 to 1)."""
        terms, w, v, bias = self.terms, self.weight, self.factors, self.bias
        chosen = docs.select(*keep, F.col("text").alias("__text"))
        kept = chosen.drop("__text").schema
        names = [*kept.names, "score"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low = np.zeros(1 << 16, bool)
            low[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
            for batch in batches:
                for start, end, texts in slices(batch.column(batch.num_columns - 1)):
                    n = end - start
                    h, row = texts.lower().terms(ALNUM, PREFIXES)
                    use = low[(h & np.uint64(0xFFFF)).astype(np.int64)]
                    h, row = h[use], row[use]
                    at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
                    use = terms[at] == h if len(terms) else np.zeros(len(h), bool)
                    pair = np.unique(row[use] * max(len(terms), 1) + at[use])
                    row, at = pair // max(len(terms), 1), pair % max(len(terms), 1)
                    total = bias + np.bincount(row, w[at], n)
                    for f in range(v.shape[1]):
                        total += (np.bincount(row, v[at, f], n) ** 2 - np.bincount(row, v[at, f] ** 2, n)) / 2
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, n) for i in range(batch.num_columns - 1)), pa.array(_logistic(total))], names)

        return chosen.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double")
