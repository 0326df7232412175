"""Prefix trie of conversations, from rolling fingerprints of all prefixes.

A turn at depth d (from 1) with content x adds x * B ** d modulo a prime to its conversation's fingerprint, so conversations
that begin with the same d turns have the same fingerprint there. Turns are numbered and summed in partitions of one order
over all conversations, by numpy scans; a conversation that several partitions share continues with the sums before it, so
no conversation has to fit in a task. Equal (depth, fingerprint) group candidates for a node. In each group all members'
turns, and the groups that they come from, are compared with those of its representative, the smallest conversation: equal
ones are first made one variant, by their content. A variant that differs is a collision; its conversations' fingerprints
are changed from that depth on, and all is verified again until none is left. As groups at each depth come from verified
groups, equal fingerprints then are equal prefixes.

Rollup needs no pass for each depth: a node's representative passes through all its ancestors. So what a node adds is
written to its representative's row, summed from each conversation's end to each of its rows, and a subtree's total is the
sum over the rows of its top.

Defined results: turns are ordered by turn (null first), then role, then text; null roles and texts are empty; repeated rows
are turns of their own; rows without a conv_id take no part; a conversation without turns is a member of the root only; an
empty table has no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Workspace

_BASE = 0x9E3779B97F4A7C15
_NODE = ["depth", "fp"]
#: Ids of one chunk of a node's list.
_CHUNK = 4096


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def running(rows: DataFrame, order: list, values: list[str], work: Workspace, name: str, rolling: bool = False) -> DataFrame:
    """rows with at, their number (from 0) within their conv_id in the given order, and running sums of values modulo
    2 ** 64. Rolling sums are of values times the base to the power of at; <value>_before is the sum without the row's own.

    Partitions are ranges of (conv_id, order), so each has at most one conversation that began in another. The sums that such
    a conversation brings along, one for each partition, are put together on the driver."""
    ordered = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).withColumn("part", F.spark_partition_id())
    names = [c for c in ordered.columns if c not in values]
    sums = [x for v in values for x in ((v, f"{v}_before") if rolling else (v,))]
    schema = ", ".join([*(f"{c} {ordered.schema[c].dataType.simpleString()}" for c in names), "at long", *(f"{c} long" for c in sums)])

    def batch_of(batch: pa.RecordBatch, at: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(at), *(pa.array(x.view(np.int64)) for x in found)], [*names, "at", *sums])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, power, before = None, 0, np.uint64(1), [np.uint64(0)] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            size = np.diff(np.append(first, len(conv)))
            goes_on = conv[0] == last
            at = np.arange(len(conv)) - np.repeat(first, size)
            factor = _powers(int(size.max()))[at] if rolling else None
            if goes_on:
                at[: size[0]] += n
                if rolling:
                    factor[: size[0]] *= power
            found = []
            for i, v in enumerate(values):
                x = batch.column(v).to_numpy().view(np.uint64)
                x = x * factor if rolling else x
                total = np.cumsum(x)
                base = np.where(first > 0, total[first - 1], np.uint64(0))
                if goes_on:
                    base[0] = np.uint64(0) - before[i]
                total -= np.repeat(base, size)
                before[i] = total[-1]
                found += [total, total - x] if rolling else [total]
            last, n = conv[-1], int(at[-1]) + 1
            power = factor[-1] * np.uint64(_BASE) if rolling else power
            yield batch_of(batch, at, found)

    done = work.keep(ordered.mapInArrow(local, schema), f"{name}-parts")
    ends = done.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).collect()
    held = [c for r in ends for c in {r.low, r.high}]
    shared = [c for c, n in Counter(held).items() if n > 1]
    if not shared:
        return done.drop("part")
    totals = done.filter(F.col("conv_id").isin(shared)).groupBy("conv_id", "part").agg(F.max(F.struct("at", *values)).alias("x")).orderBy("conv_id", "part").collect()
    carried, mask, so_far = {}, (1 << 64) - 1, None
    for r in totals:
        if so_far is None or so_far[0] != r.conv_id:
            so_far = (r.conv_id, 0, [0] * len(values))
        if so_far[1]:
            carried[r.part] = so_far
        scale = pow(_BASE, so_far[1], 1 << 64) if rolling else 1
        so_far = (r.conv_id, so_far[1] + r.x.at + 1, [(f + scale * r.x[v]) & mask for f, v in zip(so_far[2], values, strict=True)])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part, at = (batch.column(c).to_numpy() for c in ("conv_id", "part", "at"))
            at, found = at.copy(), [batch.column(c).to_numpy().view(np.uint64).copy() for c in sums]
            for p in np.unique(part).tolist():
                if p in carried:
                    c, n, before = carried[p]
                    mine = (part == p) & (conv == c)
                    at[mine] += n
                    for i, x in enumerate(found):
                        x[mine] = x[mine] * np.uint64(pow(_BASE, n, 1 << 64) if rolling else 1) + np.uint64(before[i // 2 if rolling else i])
            yield batch_of(batch, at, found)

    return done.mapInArrow(joined, schema).drop("part")


def _digests(ends: DataFrame) -> DataFrame:
    """depth, fp and ends_sha256: the digest of the conv_ids of each node, in order, comma-joined. Ids are put in order over
    all partitions and joined to chunks there, so the task that digests a node's list reads few rows, one at a time."""
    ordered = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").select(*_NODE, "conv_id")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            depth, fp, conv = (batch.column(i).to_numpy() for i in range(3))
            new = np.append(True, (depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1]))
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new | ((np.arange(len(conv)) - first[group]) % _CHUNK == 0))
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(first.tolist(), np.append(first[1:], len(conv)).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(depth[first]), pa.array(fp[first]), pa.array(conv[first]), pa.array(text, pa.string())], [*_NODE, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for d, f, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids")), strict=True):
                if (d, f) == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (d, f), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], [*_NODE, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], [*_NODE, "ends_sha256"])

    parts = ordered.mapInArrow(chunks, "depth long, fp long, first long, ids string")
    return parts.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digest, "depth long, fp long, ends_sha256 string")


@dataclass(frozen=True)
class PrefixTrie:
    """bits: bits of a fingerprint; fewer than 64 only cost time, for splitting collisions."""

    bits: int = 64

    def ordered(self, turns: DataFrame, work: Workspace) -> DataFrame:
        """conv_id, at (from 0), role and text of all turns."""
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        # Equal rows may stand in any order; the salt lets them go to different partitions. It is taken where rows are read,
        # so that a task that is run again after a loss takes the same.
        rows = turns.select(F.col("conv_id").cast("long"), "turn", text("role"), text("text"), F.xxhash64(F.monotonically_increasing_id()).alias("salt")).filter("conv_id is not null")
        return running(rows, ["turn", "role", "text", "salt"], [], work, "ordered").select("conv_id", "at", "role", "text")

    def nodes(self, turns: DataFrame, conversations: DataFrame) -> DataFrame:
        """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of
        each node; turns has conv_id, at (an order), role and text, conversations every conv_id."""
        work = Workspace(turns.sparkSession, "prefix-trie")
        convs = work.keep(conversations.select("conv_id").filter("conv_id is not null").distinct(), "conversations")
        rows = turns.select("conv_id", F.col("at").alias("order"), "role", "text", F.xxhash64("role", "text").alias("x"))
        rows = running(rows, ["order"], ["x"], work, "rolling", rolling=True)
        short = lambda c: F.col(c).bitwiseAND((1 << self.bits) - 1 if self.bits < 64 else -1)
        rows = work.keep(rows.select("conv_id", (F.col("at") + 1).alias("depth"), short("x").alias("fp"), short("x_before").alias("parent"), "role", "text"), "rows")
        rows, variants = self._verified(rows, work)

        root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
        root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), F.lit(None).cast("long").alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"))
        nodes = root.unionByName(variants.select(*_NODE, "parent", "conv_id", "n_convs", F.octet_length("text").cast("long").alias("bytes")))
        children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("fp")).agg(F.count("*").alias("n_children"))
        nodes = work.keep(nodes.join(children, _NODE, "left").fillna(0, ["n_children"]), "nodes")

        # Each node is joined to one row, that of its smallest member.
        own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
        paths = rows.select("conv_id", *_NODE).unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp")))
        paths = paths.join(own, ["conv_id", "depth"], "left").fillna(0, ["saved", "leaf"]).withColumn("order", -F.col("depth"))
        paths = work.keep(running(paths, ["order"], ["saved", "leaf"], work, "paths"), "paths")
        totals = paths.groupBy(*_NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
        digests = _digests(paths.filter("at = 0"))

        above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        out = nodes.join(totals, _NODE).join(digests, _NODE, "left").join(above, ["depth", "parent"], "left")
        none = F.lit(hashlib.sha256().hexdigest())
        return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))

    def _verified(self, rows: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
        """The rows without collisions, and one variant for each node: conv_id (the smallest), n_convs and content."""
        content = ["parent", "role", "text"]
        for turn in range(1 << 30):
            variants = work.keep(rows.groupBy(*_NODE, *content).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), f"variants-{turn}")
            group = variants.groupBy(*_NODE).agg(F.count("*").alias("c"), F.min("conv_id").alias("rep")).filter("c > 1").select(*_NODE, "rep")
            other = work.keep(variants.join(group, _NODE).filter("conv_id <> rep").select(*_NODE, *content), f"collisions-{turn}")
            if other.isEmpty():
                return rows, variants
            # The shallowest collision of a conversation changes its fingerprints from there on; all that share it agree.
            salt = F.xxhash64(F.lit(turn), *content)
            split = rows.join(other, [*_NODE, *content], "left_semi").groupBy("conv_id").agg(F.min(F.struct("depth", salt.alias("salt"))).alias("split"))
            changed = rows.join(split, "conv_id", "left")
            fp = F.when(F.col("depth") >= F.col("split.depth"), F.xxhash64("fp", "split.salt")).otherwise(F.col("fp"))
            parent = F.when(F.col("depth") > F.col("split.depth"), F.xxhash64("parent", "split.salt")).otherwise(F.col("parent"))
            rows = work.keep(changed.select("conv_id", "depth", fp.alias("fp"), parent.alias("parent"), "role", "text"), f"rows-{turn}")
        raise AssertionError


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations, and all conversations: each begins with the first h turns of conversation
    c - c % 5 in place of its own first h, where h is the checksum of c modulo 9."""
    work = Workspace(turns.sparkSession, "prefix-rebuilt")
    rows = work.keep(PrefixTrie().ordered(turns, work), "ordered")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = rows.select("conv_id").distinct()
    givers = rows.filter("at < 8 and conv_id % 5 = 0").withColumnRenamed("conv_id", "giver")
    takers = convs.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("giver"))
    heads = takers.join(givers, "giver").filter("at < h").select("conv_id", "at", "role", "text")
    return heads.unionByName(rows.filter(F.col("at") >= h).select("conv_id", "at", "role", "text")), convs


#: The trie of rebuilt conversations for DuckDB, prefixes being lists of turns. The checksum is worked out bit by bit.
SQL = """WITH o AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS giver, xor(list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda t, z: xor(t >> 1, 3988292384 * (t & 1)))), 4294967295) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT c.conv_id, pos, role, text FROM c JOIN o ON o.conv_id = giver WHERE pos < h
      UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN o USING (conv_id) WHERE pos >= h),
p AS (SELECT conv_id, row_number() OVER w AS depth, list([role, text]) OVER w AS path, text FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
      UNION ALL SELECT conv_id, 0, [], '' FROM c),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(text)) AS saved FROM p GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path, depth)),
s AS (SELECT path[1:up] AS path, up AS depth, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
      FROM (SELECT *, unnest(range(depth + 1)) AS up FROM v) GROUP BY ALL),
e AS (SELECT path, depth, string_agg(conv_id, ',' ORDER BY conv_id) AS ends FROM p JOIN l USING (conv_id, depth) GROUP BY path, depth)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM v JOIN s USING (path, depth) LEFT JOIN e USING (path, depth) LEFT JOIN n u ON u.depth = v.depth - 1 AND u.path = v.path[1:v.depth - 1]"""
