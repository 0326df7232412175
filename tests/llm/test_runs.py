"""Periodic runs against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasktide.llm import periodic_runs
from tasktide.llm.periodic_runs import PeriodicRuns, _Ids, digests, planted
from tasktide.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_runs(w, least, times):
    """(start, length, period) of every run, by start and period, from the definition: each period's maximal stretches, those
    with a smaller period left out."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 24, 3)
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    rest = " ".join(x for i, x in enumerate(w) if i not in dropped)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *head, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(rest))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed, monkeypatch):
    """Few different words, planted repetitions, several rows at once; with hashes from the first word on, and without."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(0, 5)):
            unit = rng.integers(0, rng.integers(1, 4), rng.integers(1, 9))
            parts += [*np.tile(unit, rng.integers(1, 30))[: rng.integers(0, 90)], *rng.integers(0, 3, rng.integers(0, 20))]
        rows.append([int(x) for x in parts])
    first = np.append(0, np.cumsum([len(r) for r in rows]))
    ids = np.array([x for r in rows for x in r], np.int64)
    for least, times in ((24, 3), (4, 2), (6, 3)):
        expected = [(i, *x) for i, r in enumerate(rows) for x in brute_runs(r, least, times)]
        for steps, hashed in ((16, True), (1, True), (1, False)):
            monkeypatch.setattr(periodic_runs, "_STEPS", steps)
            s, e, q = _Ids(ids, first, hashed).runs(least, times)
            row = np.searchsorted(first, s, "right") - 1
            assert list(zip(row.tolist(), (s - first[row]).tolist(), (e - s).tolist(), q.tolist(), strict=True)) == expected


def test_runs_where_all_hashes_are_equal(monkeypatch):
    monkeypatch.setattr(_Ids, "_same", lambda self, a, b, n: np.ones(len(a), bool))
    ids = np.array([*range(40), *[1, 2, 3] * 40, *range(99, 60, -1), 7] * 2)
    s, e, q = _Ids(ids, np.array([0, len(ids)])).runs(24, 3)
    assert list(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == brute_runs(ids.tolist(), 24, 3)


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(texts) and {r.doc_id: tuple(r)[1:] for r in rows} == {i: brute(i, t) for i, t in texts.items()}
    assert sum(r.n_runs > 0 for r in rows) > 5


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "x " * 30), (4, "ab cd " * 100), (5, "one\ttwo\n" * 12), (5, "one\ttwo\n" * 12), (6, "é 中 " * 9), (7, "a b\x00c " * 12), (8, "word")]
    rows += [(i, "p q r s t u v w x y z " * 3) for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("runs", "collapsed", "n_words", "h", "words", "best", "p")})
    found = sorted((tuple(r) for r in digests(PeriodicRuns().collapse(planted(docs), ["doc_id"])).collect()), key=str)
    assert found == sorted(((i, *brute(i, t)) for i, t in rows), key=str)
    plain = PeriodicRuns().collapse(docs.filter("doc_id in (1, 2, 4)").withColumn("text", F.when(F.col("doc_id") == 4, F.repeat(F.lit("ab cd "), 60_000)).otherwise(F.col("text"))), ["doc_id"])
    assert {r.doc_id: (r.n_words, len(r.runs), r.collapsed) for r in plain.collect()} == {1: (0, 0, ""), 2: (0, 0, ""), 4: (120_000, 1, "ab cd")}
    none = digests(PeriodicRuns().collapse(planted(docs.limit(0)), ["doc_id"]))
    assert none.count() == 0 and none.schema["length"].dataType.simpleString() == "bigint"
