"""The prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tasktide.llm import prefix_trie
from tasktide.llm.prefix_trie import PrefixTrie, rebuilt, running
from tasktide.llm.queries import QUERIES, SQL
from tasktide.llm.tables import Workspace

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    """All nodes, from the definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(seed, convs=40, words=("a", "b"), most=14):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "user", None]), r.choice(words)) for c in range(convs) for t in range(r.randrange(most)) for _ in range(r.choice([1, 1, 1, 2]))]
    r.shuffle(rows)
    return rows


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_prefix_trie"](spark, SF)) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_collisions_are_split(spark, seed):
    """Fingerprints of two bits: most groups hold several prefixes."""
    rows = random_rows(seed, 30, most=10)
    turns, convs = rebuilt(spark.createDataFrame(rows, SCHEMA))
    assert found(PrefixTrie(bits=2).nodes(turns, convs)) == brute(rows)


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rows = db.execute(SQL["op12_prefix_trie"])
    names = [d[0] for d in rows.description]
    expected = sorted(map(str, rows.fetchall()))
    assert sorted(str(tuple(r[n] for n in names)) for r in QUERIES["op12_prefix_trie"](spark, SF).collect()) == expected


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_CHUNK", 3)
    rows = [(None, 0, "user", "no conversation"), (7, None, None, None), (7, 0, "user", "b"), (7, 0, "user", "b"), (7, 0, "assistant", "é中🙂" * 3000), (-3, 1, "", ""), (10, 5, "user", "x")]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(4)]  # copies
    rows += [(5, t, "user", f"w {t % 7}") for t in range(3000)]  # a long conversation, also a giver
    rows += [(c, 0, "user", "hello") for c in range(1000, 1012)]  # some are turnless once rebuilt
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("at", "depth", "fp", "parent", "part", "x", "h", "order", "saved", "leaf", "bytes")})
    expected = brute([r for r in rows if r[0] != -3])
    assert found(PrefixTrie().nodes(*rebuilt(df.filter("conv_id is null or conv_id <> -3")))) == expected
    assert found(PrefixTrie().nodes(*rebuilt(df.filter("conv_id = -3"))))[0][:2] == (-3, 0)
    assert PrefixTrie().nodes(*rebuilt(df.limit(0))).count() == 0


def test_running_sums_go_on_over_partitions(spark):
    """A conversation with most of the rows lies in several partitions; its sums are those of one scan."""
    df = spark.range(4000).select(F.when(F.col("id") % 10 < 8, 3).otherwise(F.col("id") % 40).cast("long").alias("conv_id"), F.col("id").alias("o"), F.xxhash64("id").alias("x"))
    expected, at, sums, power = {}, defaultdict(int), defaultdict(int), defaultdict(lambda: 1)
    for r in df.orderBy("o").collect():
        term = power[r.conv_id] * r.x % 2**64
        before = sums[r.conv_id]
        sums[r.conv_id] = (before + term) % 2**64
        expected[r.o] = (at[r.conv_id], sums[r.conv_id], before)
        at[r.conv_id] += 1
        power[r.conv_id] = power[r.conv_id] * prefix_trie._BASE % 2**64
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        out = running(df.repartition(5), ["o"], ["x"], Workspace(spark, "t"), "a", rolling=True).collect()
        plain = running(df.withColumn("x", F.lit(1).cast("long")), ["o"], ["x"], Workspace(spark, "t"), "b").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.o: (r.at, r.x % 2**64, r.x_before % 2**64) for r in out} == expected
    assert {r.o: r.x for r in plain} == {o: a + 1 for o, (a, _, _) in expected.items()}
