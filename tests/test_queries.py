"""Every registered query against its SQL, both on the same tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tasktide.plans import registry, tasks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    return str(value.normalize() + 0) if isinstance(value, decimal.Decimal) else repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    found = db.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == expected


def test_all_queries_have_sql():
    assert set(registry.SQL) == set(registry.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 8 and set(entry.oracle_sql()) <= set(entry.queries())


def test_instances_and_histories_hold_no_more_than_they_show(spark, tmp_path):
    """Arrays grow with the types of events and with n, not with the number of events."""
    rows = [(i, f"2024-01-01 00:00:{i % 60:02d}", i % 2, "click" if i % 3 else "view") for i in range(700)]
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
    frame.selectExpr("event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.id: (len(r.metrics), sum(m.value for m in r.metrics), r.events) for r in tasks._instances(spark, str(tmp_path)).collect()} == {i: (2, 100.0, 100) for i in range(7)}
    last = {u: sorted(sorted((r[1], r[0]) for r in rows if r[2] == u)[-5:]) for u in (0, 1)}
    kept = registry.QUERIES["history_last_n"](spark, str(tmp_path))
    assert {r.user_id: r.kept for r in kept.collect()} == {u: str([i for _, i in x]) for u, x in last.items()}
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
