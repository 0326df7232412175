"""Near-duplicate detection by min-max hashing.

Each document's set of distinct word shingles is hashed under K random permutations; both the minimum and the maximum
of every permutation are kept, so 2K signature values cost K hash evaluations. Bands of `rows` values (minima with
minima, maxima with maxima) give buckets. Documents with equal sets are one class, so copies are one row from then on.

Links inside buckets are found without listing a bucket's pairs: every member is compared with the bucket's centre, the
member that shares most buckets with others. Copies of one text are then one component, but for those that stand apart
from every centre. Only where a bucket still holds several components, its members are compared again, over all that
buckets connect, by counting common shingles over an inverted list in blocks of bounded size; only links leave a block.
What is skipped lies within one component, so no component changes by it. Every link is confirmed on the full sets of
64-bit shingle hashes.

Defined results: a null or wordless text has an empty set, n_shingles 0 and its own component; fewer words than a
shingle count as one shingle; a row without doc_id takes no part (component_id null, kept true); rows that repeat a
doc_id are one document, linked with whatever any of its texts is similar to, so they get the same component (but for
empty texts, which have their own id); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .tables import Workspace
from .words import NOT_SPACE, Texts, as_long, mix, slices

_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


@dataclass(frozen=True)
class NearDedup:
    """shingle: words of a shingle. similarity: percent of intersection to union. rows: signature values in a band.
    permutations: hash evaluations for each shingle; twice as many signature values. The chance to miss a pair at
    0.8 is (1 - 0.8 ** rows) ** bands with bands = 2 * permutations // rows: 5e-6 as set here. block_shingles: shingles
    of a block, which bound the memory of a comparison."""

    shingle: int = 5
    similarity: int = 80
    rows: int = 6
    permutations: int = 120
    block_shingles: int = 500_000
    seed: int = 7

    def _sets(self, texts: Texts) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each row."""
        words = texts.lower().words(NOT_SPACE)
        h, at = words.windows(self.shingle)
        first = np.searchsorted(at, words.first)
        short, short_at = (None, None)
        for i in range(len(texts.valid)):
            n = int(words.first[i + 1] - words.first[i])
            if n >= self.shingle:
                yield np.unique(h[first[i] : first[i + 1]])
            elif n == 0:
                yield np.zeros(0, np.uint64)
            else:
                if short is None:
                    short, short_at = {}, words.first
                if n not in short:
                    short[n] = words.windows(n)
                g, g_at = short[n]
                yield g[np.searchsorted(g_at, short_at[i])][None]

    def sketch(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, a 128-bit name of the set (set_a, set_b) and its band values."""
        multipliers = [np.array(x * 2 + 1, np.uint64) for x in np.random.default_rng(self.seed).integers(1, 2**62, self.permutations, dtype=np.uint64)]
        n_rows, n_bands = self.rows, self.permutations // self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for start, end, texts in slices(batch.column(1)):
                    sets = list(self._sets(texts))
                    size = np.array([len(s) for s in sets], np.int64)
                    names = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
                    full = size > 0
                    bands = np.zeros((int(full.sum()), 2 * n_bands), np.uint64)
                    if full.any():
                        h = np.concatenate(sets)
                        at = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                        for k, a in enumerate(multipliers[: n_rows * n_bands]):
                            x = h * a
                            band = k // n_rows
                            for side, f in enumerate((np.minimum, np.maximum)):
                                j = 2 * band + side
                                bands[:, j] = mix(bands[:, j] * np.uint64(31) + f.reduceat(x, at) + np.uint64(j + 1))
                    offsets = np.concatenate([[0], np.cumsum(full * 2 * n_bands)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(start, end - start), pa.array(size), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_long(bands.reshape(-1))))],
                        ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                    )

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SKETCH)

    def shingles(self, docs: DataFrame) -> DataFrame:
        """doc_id and the whole shingle set."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, end, texts in slices(batch.column(1)):
                    sets = list(self._sets(texts))
                    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    values = pa.array(as_long(np.concatenate(sets)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "shingles"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, shingles array<long>")

    def _alike(self, a: str, b: str):
        """What similar sets' sizes must hold."""
        return 100 * F.least(a, b) >= self.similarity * F.greatest(a, b)

    def _confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose full sets are similar enough."""
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        joined = pairs.join(left, "a").join(right, "b")
        return joined.filter(100 * both >= self.similarity * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")

    def classes(self, docs: DataFrame) -> tuple[DataFrame, Workspace]:
        """One row per row of docs: doc_id, n_shingles, component_id, kept."""
        work = Workspace(docs.sparkSession, "near-dedup")
        sketch = work.keep(self.sketch(docs), "sketch")
        names = work.keep(sketch.select("doc_id", "n_shingles", "set_a", "set_b"), "names")
        usable = "n_shingles > 0 and doc_id is not null"
        of_set = sketch.filter(usable).groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        posts = of_set.select("rep", F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket"))
        shared = posts.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
        posts = work.keep(posts.join(shared, "bucket"), "posts")
        work.drop("sketch")
        ids = posts.select(F.col("rep").alias("doc_id")).distinct()
        texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi")
        sets = work.keep(self.shingles(texts.withColumn("hash", F.xxhash64("text")).dropDuplicates(["doc_id", "hash"])), "sets")
        rep = names.filter(usable).groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))

        degree = posts.groupBy("rep").agg(F.sum("c").alias("degree"))
        ranked = posts.join(degree, "rep")
        edges = self._confirm(self._spokes(posts, ranked, F.struct("degree", -F.col("rep"))), sets)
        edges = work.keep(edges.unionByName(self._of_one_id(names.filter(usable), rep)), "edges-0")
        stars = components(edges, work, "stars-0")

        apart = work.keep(self._apart(posts, stars), "apart")
        edges = work.keep(self._within(self._blocks(apart, work), sets), "edges-1")
        stars = components(edges.unionByName(stars.select(F.col("v").alias("a"), F.col("m").alias("b"))), work, "stars-1")

        # Written, so that Spark knows its size and can split the join where very many rows have one set.
        found = rep.join(stars.select(F.col("v").alias("rep"), "m"), "rep", "left").select("set_a", "set_b", F.coalesce("m", "rep").alias("component_id"))
        found = work.keep(found, "classes")
        for name in ("posts", "sets", "edges-0", "edges-1", "apart", "low"):
            work.drop(name)  # what the result reads is the names and the classes

        joined = names.filter(usable).join(found, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
        alone = names.filter(f"not ({usable})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), work

    def _of_one_id(self, names: DataFrame, rep: DataFrame) -> DataFrame:
        """Edges from a doc_id that has several sets to the smallest doc_id of each of them."""
        name = F.struct("set_a", "set_b")
        several = names.groupBy("doc_id").agg(F.min(name).alias("low"), F.max(name).alias("high")).filter("low <> high").select("doc_id")
        return names.join(several, "doc_id", "left_semi").join(rep, ["set_a", "set_b"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")

    def _spokes(self, posts: DataFrame, ranked: DataFrame, rank) -> DataFrame:
        """Pairs of each bucket's highest-ranked member with its other members."""
        centre = ranked.groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), "rep", "n")).alias("x"))
        centre = centre.select("bucket", F.col("x.rep").alias("c_rep"), F.col("x.n").alias("c_n"))
        pairs = posts.join(centre, "bucket").filter((F.col("rep") != F.col("c_rep")) & self._alike("n", "c_n"))
        return pairs.select(F.least("rep", "c_rep").alias("a"), F.greatest("rep", "c_rep").alias("b")).distinct()

    def _blocks(self, apart: DataFrame, work: Workspace) -> DataFrame:
        """rep, n, part and, for each pair of blocks of its cluster that one of them is rep's, cluster, x, y and whether
        rep is in x. A cluster is all that shared buckets connect; a block has about block_shingles shingles.

        Members of a cluster's largest part have blocks of their own, which are paired with the others' blocks only: they are
        one component already. So a member of a large group of copies is repeated for blocks of what isn't in the group."""
        # Written, so that its size is known before the join: where it is small, the members of a hot bucket stay where they are.
        low = work.keep(apart.groupBy("bucket").agg(F.min("rep").alias("low")), "low")
        linked = components(apart.join(low, "bucket").select(F.col("rep").alias("a"), F.col("low").alias("b")), work, "clusters")
        reps = apart.select("rep", "n", "part").distinct().join(linked.select(F.col("v").alias("rep"), "m"), "rep", "left").withColumn("cluster", F.coalesce("m", "rep")).drop("m")
        parts = reps.groupBy("cluster", "part").agg(F.sum("n").alias("n"))
        largest = parts.groupBy("cluster").agg(F.max(F.struct("n", "part")).alias("hub"), F.sum("n").alias("n"))
        count = lambda n: F.ceil(n / self.block_shingles).cast("int")
        blocks = largest.select("cluster", F.col("hub.part").alias("hub"), count(F.col("n") - F.col("hub.n")).alias("others"), count(F.col("hub.n")).alias("hubs"))
        number = F.xxhash64("rep")
        in_hub = F.col("part") == F.col("hub")
        own = F.when(in_hub, F.col("others") + F.pmod(number, "hubs")).otherwise(F.pmod(number, "others")).cast("int")
        facing = F.sequence(F.lit(0), F.when(in_hub, F.col("others")).otherwise(F.col("others") + F.col("hubs")) - 1)
        each = reps.join(blocks, "cluster").filter("others > 0").withColumn("own", own).withColumn("other", F.explode(facing))
        return each.select("cluster", "rep", "n", "part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("in_x"))

    def _within(self, blocks: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) between different parts of a pair of blocks, by counting common shingles over an inverted list.

        Members of the largest part are not compared with one another, and a member fewer than `similarity` percent of
        whose shingles are in any other member is compared with none."""
        percent = self.similarity

        def run(group: pa.Table) -> pa.Table:
            rep, part, in_x = (group.column(c).to_numpy() for c in ("rep", "part", "in_x"))
            lists = group.column("shingles").combine_chunks()
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            token, df = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)[1:]
            use = df[token] > 1
            row, token = row[use], token[use]
            order = np.argsort(token, kind="stable")
            at = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(df)))])
            holders, first = row[order], np.searchsorted(row, np.arange(len(n) + 1))
            same = bool((group.column("x").to_numpy() == group.column("y").to_numpy()).all())
            parts, index = np.unique(part, return_inverse=True)
            hub = np.bincount(index).argmax() if len(index) else 0
            found_a, found_b = [], []
            for i in np.flatnonzero((index != hub) & (100 * np.diff(first) >= percent * n)):
                t = token[first[i] : first[i + 1]]
                size = at[t + 1] - at[t]
                place = np.arange(size.sum()) + np.repeat(at[t] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                both = np.bincount(holders[place], minlength=len(n))
                link = (100 * both >= percent * (n[i] + n - both)) & (index != index[i])
                if not same:
                    link &= in_x != in_x[i]
                j = np.flatnonzero(link)
                found_a.append(np.minimum(rep[i], rep[j]))
                found_b.append(np.maximum(rep[i], rep[j]))
            ends = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (found_a, found_b)]
            return pa.table({"a": ends[0], "b": ends[1]})

        members = blocks.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
        return members.groupBy("cluster", "x", "y").applyInArrow(run, "a long, b long").distinct()

    def _apart(self, posts: DataFrame, stars: DataFrame) -> DataFrame:
        """Members, with their component as part, of the buckets that still hold more than one component."""
        known = posts.join(stars.select(F.col("v").alias("rep"), "m"), "rep", "left").select("bucket", "rep", "n", F.coalesce("m", "rep").alias("part"))
        mixed = known.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("bucket")
        return known.join(mixed, "bucket")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, for each row of docs."""
    return NearDedup(shingle=shingle, similarity=similarity).classes(docs)[0]


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: int = 80) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id. Rows without doc_id stay. Of rows that
    repeat doc_id and text one stays; of those that repeat a doc_id with other texts, which are one document, all or none."""
    found, work = NearDedup(shingle=shingle, similarity=similarity).classes(docs)
    gone = work.keep(found.filter("not kept").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = work.keep(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    # Only rows whose id is repeated are shuffled to be made one.
    more = kept.join(repeated, "doc_id", "left_semi").withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(more).select(docs.columns)
