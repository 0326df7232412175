"""Approximate nearest neighbours by cosine over a hash-prefix forest.

Each vector has one hash string of `bits` bits per tree: the signs of its products with random directions, first
direction first. A tree is the sorted array of its strings, so the vectors under any prefix are one range. A query
descends every tree to its longest prefix match, then ascends all trees in step, one bit at a time. What the ranges hold
are its candidates; these are compared on the original vectors in double precision as they come. The ascent ends when a
vector as near as the k-th best so far would have been found with a chance of `recall`: two vectors at an angle a agree in a
bit with a chance of 1 - a / pi. So in a dense neighbourhood long prefixes and few candidates are enough, and only where
all vectors are about equally far it goes on until a large part of them are candidates.

Rows are made distinct by id and vector before they are indexed. Vectors are dealt by a hash of both into shards of about
`rows` vectors, and queries into blocks; every block of queries searches every shard's forest, and a query's best of all
shards are merged. So memory is bounded by a shard and a block, and a vector that a third of all rows repeat is spread
evenly. A vector is sent once for each block of queries, and a query once for each shard: with a query set that is a share
of the table both grow with its square, as the comparisons do. The hash strings are a written table, the index; all rows
are in it.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors are
compared with those of their own length; of equal scores the smaller id comes first; rows that repeat an id and its
vector are one; an id with several vectors counts by its best score; a query gets all candidates where there are fewer than k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Workspace


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between a half and one: exact, and no square or
    product of it overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x


class Forest:
    """Sorted arrays of hash strings (unsigned, the first bit is the highest): one per tree."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.bits = bits
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def ranges(self, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """By tree and query: begin and end of the strings that share the first `depth` bits with the query's."""
        low = keys >> np.uint64(self.bits - depth) << np.uint64(self.bits - depth) if depth else np.zeros_like(keys)
        high = low + np.uint64((1 << (self.bits - depth)) - 1)
        begin = np.stack([np.searchsorted(k, x, "left") for k, x in zip(self.keys, low, strict=True)])
        return begin, np.stack([np.searchsorted(k, x, "right") for k, x in zip(self.keys, high, strict=True)])

    def ascend(self, keys: np.ndarray, enough: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Depth by depth, from the longest prefixes up: the depth, the queries whose ranges hold `enough` strings besides
        those equal to the query's, and the ranges' begins and ends by tree. send() the queries that have found enough."""
        waiting = np.arange(keys.shape[1])
        begin, end = self.ranges(keys, self.bits)
        equal = (end - begin).sum(axis=0)
        for depth in range(self.bits, -1, -1):
            begin, end = self.ranges(keys[:, waiting], depth)
            on = ((end - begin).sum(axis=0) - equal[waiting] >= enough) | (depth == 0)
            done = yield depth, waiting[on], begin[:, on], end[:, on]
            waiting = np.setdiff1d(waiting, done)
            if not len(waiting):
                return


@dataclass(frozen=True)
class VectorSearch:
    """trees, bits: of the forest. rows: vectors of a shard. block: queries of a block. least: strings, besides equal ones,
    that the ranges of a query hold before its candidates are first compared. recall: chance at least to find a vector as
    near as the k-th best."""

    trees: int = 48
    bits: int = 32
    rows: int = 8192
    block: int = 8192
    least: int = 200
    recall: float = 0.92
    seed: int = 3

    def index(self, vectors: DataFrame) -> DataFrame:
        """vec_id, size, v and keys (a hash string for each tree) of each different usable row. Floats stay floats, which are
        half as long, and are compared as the doubles they are equal to."""
        trees, bits, seed = self.trees, self.bits, self.seed
        kind = "float" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "double"
        v = F.transform("embedding", lambda x: x.cast("double"))
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
        usable = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), "embedding").distinct().select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            directions: dict[int, np.ndarray] = {}
            weight = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
            for batch in batches:
                size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(size).tolist():
                    part = batch.take(pa.array(np.flatnonzero(size == d)))
                    x = _matrix(part.column(1), d).astype(float)
                    if d not in directions:
                        directions[d] = np.random.default_rng(seed + d).normal(size=(d, trees * bits))
                    for a in range(0, len(x), 1000):
                        on = (_scaled(x[a : a + 1000]) @ directions[d] > 0).reshape(-1, trees, bits)
                        keys = pa.array((on * weight).sum(axis=2).astype(np.uint32).view(np.int32).reshape(-1))
                        n = len(on)
                        yield pa.RecordBatch.from_arrays([part.column(0).slice(a, n), pa.array(np.full(n, d, np.int32)), part.column(1).slice(a, n), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * trees), keys)], ["vec_id", "size", "v", "keys"])

        return usable.mapInArrow(run, f"vec_id long, size int, v array<{kind}>, keys array<int>")

    def _strings(self, rows: pa.Table) -> np.ndarray:
        """Hash strings by tree and row."""
        return _matrix(rows.column("keys"), self.trees).view(np.uint32).T.astype(np.uint64)

    def depth(self, score: float) -> int:
        """The longest prefix at which a vector of this cosine is missed in all trees with a chance of 1 - recall at most."""
        same = 1 - np.arccos(np.clip(score, -1, 1)) / np.pi
        if same in (0, 1):
            return self.bits * int(same)
        return int(min(self.bits, np.log(1 - (1 - self.recall) ** (1 / self.trees)) / np.log(same)))

    def _search(self, forest: Forest, x: np.ndarray, norm: np.ndarray, ids: np.ndarray, of_id: np.ndarray, q_ids: np.ndarray, q: np.ndarray, keys: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
        """For each query its k nearest other ids among the vectors x; of_id is a vector's place in ids."""
        q_norm = np.sqrt((q * q).sum(axis=1))
        seen = np.zeros((len(q), len(x)), bool)
        best = np.full((len(q), len(ids)), -np.inf)
        steps, done = forest.ascend(keys, self.least), None
        while True:
            try:
                depth, asking, begin, end = steps.send(done)
            except StopIteration:
                break
            done = []
            for j, i in enumerate(asking.tolist()):
                reached = np.zeros(len(x), bool)
                for order, b, e in zip(forest.order, begin[:, j].tolist(), end[:, j].tolist(), strict=True):
                    reached[order[b:e]] = True
                new = np.flatnonzero(reached & ~seen[i])
                seen[i, new] = True
                new = new[ids[of_id[new]] != q_ids[i]]
                np.maximum.at(best[i], of_id[new], np.einsum("ij,j->i", x[new], q[i]) / (norm[new] * q_norm[i]))
                if depth == 0 or (len(ids) >= k and depth <= self.depth(np.partition(best[i], -k)[-k])):
                    done.append(i)
        out = []
        for i, score in enumerate(best):
            found = np.flatnonzero(score >= max(np.partition(score, -k)[-k] if len(ids) > k else -2, -2))
            found = found[np.lexsort((ids[found], -score[found]))][:k]
            out.append((np.full(len(found), q_ids[i]), ids[found], score[found]))
        return out

    def nearest(self, vectors: DataFrame, asks: Column, k: int) -> DataFrame:
        """query_id, rank, vec_id, score: for each vector for which asks holds, the k nearest others found."""
        work = Workspace(vectors.sparkSession, "vector-search")
        index = work.keep(self.index(vectors), "index")
        sizes = index.agg(F.count("*").alias("n"), F.count_if(asks).alias("q")).first()
        shards, blocks = max(1, -(-sizes.n // self.rows)), max(1, -(-sizes.q // self.block))
        row = index.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
        right = row.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        left = index.filter(asks).withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        schema = "query_id long, vec_id long, score double"

        def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if queries.num_rows and rows.num_rows:
                d = rows.column("size")[0].as_py()
                x = _scaled(_matrix(rows.column("v"), d).astype(float))
                norm = np.sqrt((x * x).sum(axis=1))
                forest = Forest(self._strings(rows), self.bits)
                ids, of_id = np.unique(rows.column("vec_id").to_numpy(), return_inverse=True)
                for at in range(0, queries.num_rows, 256):
                    part = queries.slice(at, 256)
                    out += self._search(forest, x, norm, ids, of_id, part.column("vec_id").to_numpy(), _scaled(_matrix(part.column("v"), d).astype(float)), self._strings(part), k)
            return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

        keys = ("size", "shard", "block")
        # The work of a group is large for its bytes, so the number of tasks goes by groups.
        tasks = min(4 * shards * blocks, 10_000)
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
