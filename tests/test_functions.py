"""Filters, projections, intervals and policies against their exact vectors."""

import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tasktide.functions.intervals import Cron, duration_ms, interval_function
from tasktide.functions.predicates import Filters, normalize, register_operator
from tasktide.functions.projection import watched
from tasktide.model import CleanupPolicy, Evolution, Registry, RetryPolicy, TaskDefinition
from tasktide.operators.listing import parse_statuses, smart_ids

NOW = datetime(2023, 1, 1)
SCHEMA = "id long, n long, m long, s string, at timestamp_ntz, tags array<string>, meta struct<kind:string,size:long>, log array<struct<action:string,user:string>>, ok boolean"
ROWS = [
    (1, 10, 5, "ERR-123", datetime(2022, 12, 31), ["a", "b"], ("x", 7), [("login", "eve")], True),
    (2, 75, 100, "WARN-1", datetime(2023, 6, 1), ["c"], ("y", 3), [], False),
    (3, None, None, None, None, None, None, None, None),
    (4, 100, 100, "err-9", datetime(2023, 1, 1), [], (None, None), [("logout", "eve"), ("login", "bob")], None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ({}, [1, 2, 3, 4]),
        (None, [1, 2, 3, 4]),
        ({"n": 10}, [1]),
        ({"n": {"$eq": 10}}, [1]),
        ({"n": {"$ne": 10}}, [2, 3, 4]),
        ({"n": {"$gt": 10}}, [2, 4]),
        ({"n": {"$gte": 50, "$lt": 100}}, [2]),
        ({"n": {"$lt": 50}}, [1, 3]),
        ({"n": {"$lte": 10}}, [1, 3]),
        ({"n": {"$in": [10, 100]}}, [1, 4]),
        ({"n": {"$in": [10, None]}}, [1, 3]),
        ({"n": {"$nin": [10]}}, [2, 3, 4]),
        ({"n": {"$in": []}}, []),
        ({"s": None}, [3]),
        ({"s": {"$ne": None}}, [1, 2, 4]),
        ({"s": {"$exists": True}, "n": {"$exists": True}}, [1, 2, 4]),
        ({"s": {"$exists": False}}, [3]),
        ({"s": {"$regex": "^ERR-\\d{3}$"}}, [1]),
        ({"s": {"$regex": "^err", "$options": "i"}}, [1, 4]),
        ({"s": re.compile("^err", re.I)}, [1, 4]),
        ({"$nor": [{"s": {"$regex": "^ERR"}}, {"n": 75}]}, [3, 4]),
        ({"$or": [{"n": 10}, {"meta.kind": "y"}]}, [1, 2]),
        ({"$and": [{"n": {"$gt": 1}}, {"m": 100}]}, [2, 4]),
        ({"$not": {"n": 10}}, [2, 3, 4]),
        ({"meta.kind": "x", "meta.size": {"$gt": 5}}, [1]),
        ({"meta": {"kind": "x", "size": 7}}, [1]),
        ({"tags": {"$size": 2}}, [1]),
        ({"tags": ["c"]}, [2]),
        ({"n": {"$type": "long"}}, [1, 2, 4]),
        ({"n": {"$type": "string"}}, []),
        ({"missing": {"$exists": False}}, [1, 2, 3, 4]),
        ({"missing": {"$lt": 1}}, [1, 2, 3, 4]),
        ({"ok": True}, [1]),
        ({"at": {"$lt": NOW}}, [1, 3]),
        ({"$expr": {"$gt": ["$m", "$n"]}}, [2]),
        ({"$expr": {"$lt": ["$at", "$$NOW"]}}, [1, 3]),
        ({"$expr": {"$lt": [{"$add": ["$at", 1000]}, "$$NOW"]}}, [1, 3]),
        ({"$expr": {"$gt": [{"$size": {"$setIntersection": ["$tags", ["a", "c"]]}}, 0]}}, [1, 2]),
        ({"$expr": {"$gt": [{"$size": {"$filter": {"input": "$log", "as": "l", "cond": {"$and": [{"$eq": ["$$l.action", "login"]}, {"$eq": ["$$l.user", "bob"]}]}}}}, 0]}}, [4]),
        ({"$expr": {"$regexMatch": {"input": "$s", "regex": "^err", "options": "i"}}}, [1, 4]),
        ({"$expr": {"$eq": [{"$type": "$s"}, "missing"]}}, [3]),
        ({"$expr": {"$in": ["a", "$tags"]}}, [1]),
        ({"$expr": {"$cond": [{"$gt": ["$n", 50]}, True, False]}}, [2, 4]),
        ({"$expr": {"$gt": [{"$ifNull": ["$n", 500]}, 90]}}, [3, 4]),
        ({"$expr": {"$gt": [{"$subtract": ["$$NOW", "$at"]}, 0]}}, [1]),
        ({"$expr": {"$eq": [{"$arrayElemAt": ["$tags", 0]}, "c"]}}, [2]),
        ({"$expr": {"$eq": [{"$size": {"$slice": [{"$concatArrays": ["$tags", ["z", "y"]]}, -3]}}, 2]}}, [3, 4]),
    ],
)
def test_filters(rows, query, ids):
    f = Filters(rows.schema, NOW)
    assert sorted(r.id for r in rows.filter(f.compile(query)).collect()) == ids
    assert sorted(r.id for r in rows.filter(f.where(query)).collect()) == ids


def test_predicates_are_never_null_but_in_strict_mode(rows):
    f, strict = Filters(rows.schema), Filters(rows.schema, strict_sql=True)
    for query in ({"n": 1}, {"n": {"$lt": 1}}, {"s": {"$regex": "a"}}, {"tags": {"$size": 1}}, {"n": {"$nin": [1, None]}}):
        assert rows.filter(f.compile(query).isNull()).count() == 0
    assert rows.filter(strict.compile({"n": {"$lt": 50}})).count() == 1


@pytest.mark.parametrize(
    "query",
    [{"n": {"$elemMatch": {}}}, {"$text": {"$search": "x"}}, {"$or": {}}, {"$or": []}, {"n": {"$in": 3}}, {"n": "text"}, {"s": 3}, {"$expr": {"$unknown": 1}}, {"s": {"$regex": "a", "$options": "u"}}, {"n": {"$gt": None}}, {"n": {"$type": "odd"}}, [1]],
)
def test_filters_that_are_errors(rows, query):
    with pytest.raises(ValueError):
        Filters(rows.schema).compile(query)


def test_filters_under_an_envelope_and_pushdown(rows, spark, tmp_path):
    events = rows.select(F.struct(*rows.columns).alias("doc"))
    assert events.filter(Filters(rows.schema, prefix="doc.").compile({"n": 10, "$expr": {"$gt": ["$n", "$m"]}})).count() == 1
    rows.drop("tags", "log").write.parquet(f"file://{tmp_path}/t")
    t = spark.read.parquet(f"file://{tmp_path}/t")
    plan = t.filter(Filters(t.schema).where({"n": {"$gte": 50}, "s": "a"})).select("id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(n,50)" in plan and "EqualTo(s,a)" in plan


def test_normalize():
    assert normalize(None) == {} and normalize({}) == {}
    assert normalize({"a": 1}) == {"a": 1}
    assert normalize({"$or": [{"a": 1}]}) == {"$or": [{"a": 1}]}
    assert normalize({"$gt": ["$a", 1]}) == {"$expr": {"$gt": ["$a", 1]}}
    for bad in ("x", 3, [1], {"a": {"$elemMatch": {}}}, {"a": 1, "$gt": ["$a", 1]}):
        with pytest.raises(ValueError):
            normalize(bad)


def test_watched_values(rows):
    f = Filters(rows.schema, NOW)
    whole = rows.select(watched(f, {}, rows.schema).alias("w"))
    assert [x.name for x in whole.schema["w"].dataType.fields] == sorted(rows.columns)
    one = watched(f, {"meta.size": 1, "s": True, "total": {"$multiply": ["$n", "$m"]}}, rows.schema)
    other = watched(f, {"total": {"$multiply": ["$n", "$m"]}, "s": 1, "meta.size": 1}, rows.schema)
    assert rows.filter(one.eqNullSafe(other)).count() == 4
    assert rows.select(one.alias("w")).first().w.asDict(True) == {"meta": {"size": 7}, "s": "ERR-123", "total": 50}
    for bad in ({"s": 0}, {"s": False}, {"meta": 1, "meta.size": 1}):
        with pytest.raises(ValueError):
            watched(f, bad, rows.schema)


def test_durations():
    assert [duration_ms(x) for x in (5, "500ms", "1h", "7d", "5m 20s", "1.5s", 0)] == [5, 500, 3_600_000, 604_800_000, 320_000, 1500, 0]
    for bad in ("invalid", "", "0 3 * * *", "5", "-1s", -1, float("nan"), float("inf"), None, True):
        with pytest.raises(ValueError):
            duration_ms(bad)


@pytest.mark.parametrize(
    ("expression", "tz", "after", "then"),
    [
        ("0 3 * * *", "UTC", datetime(2023, 1, 1, 10), datetime(2023, 1, 2, 3)),
        ("0 12 * * *", "UTC", datetime(2023, 1, 1), datetime(2023, 1, 1, 12)),
        ("* * * * *", "UTC", datetime(2023, 1, 1, 0, 0, 30), datetime(2023, 1, 1, 0, 1)),
        ("*/10 * * * * *", "UTC", datetime(2023, 1, 1, 0, 0, 10), datetime(2023, 1, 1, 0, 0, 20)),
        ("0 0 29 2 *", "UTC", datetime(2023, 3, 1), datetime(2024, 2, 29)),
        ("30 8 * * mon-fri", "UTC", datetime(2023, 1, 6, 9), datetime(2023, 1, 9, 8, 30)),
        ("0 0 13 * 5", "UTC", datetime(2023, 1, 1), datetime(2023, 1, 6)),
        ("0 3 * * *", "Europe/Berlin", datetime(2023, 1, 1, 10), datetime(2023, 1, 2, 2)),
        ("15,45 9-17/4 1 jan,jul *", "UTC", datetime(2023, 1, 1, 9, 15), datetime(2023, 1, 1, 9, 45)),
        ("0 0 * * 7", "UTC", datetime(2023, 1, 2), datetime(2023, 1, 8)),
    ],
)
def test_cron(expression, tz, after, then):
    assert Cron(expression, tz).next(after) == then
    assert interval_function("CRON " + expression, tz)(after) == then == interval_function("cron " + expression, tz)(after)


def test_intervals_that_are_errors():
    for bad in ("CRON invalid", "CRON 99 * * * *", "* * * * *", "CRON 0 0 30 2"):
        with pytest.raises(ValueError):
            interval_function(bad)
    with pytest.raises(ValueError):
        Cron("0 0 30 2 *").next(NOW)
    assert interval_function("1h")(NOW) == datetime(2023, 1, 1, 1)
    assert interval_function(lambda at: 1000)(NOW) == datetime(2023, 1, 1, 0, 0, 1)


@pytest.mark.parametrize(
    ("policy", "waits"),
    [
        (RetryPolicy("linear", interval="1m"), [60, 120, 180, 240, 300]),
        (RetryPolicy("exponential", min="1s", max="10s", factor=2), [1, 2, 4, 8, 10]),
        (RetryPolicy("exponential", min="1s"), [1, 2, 4, 8, 16]),
        (RetryPolicy("fixed", interval="10s"), [10] * 5),
        (RetryPolicy("series", intervals=("1s", "10s", "1m")), [1, 10, 60, 60, 60]),
        (RetryPolicy("cron", expression="0 12 * * *"), [43200] * 5),
        (RetryPolicy(), [10, 20, 40, 80, 160]),
    ],
)
def test_retry_waits(spark, policy, waits):
    at = spark.range(1, 6).orderBy("id").select(policy.next_try(F.col("id"), NOW).alias("t")).collect()
    assert [(r.t - NOW).total_seconds() for r in at] == waits


def test_giving_up(spark):
    df = spark.createDataFrame([(2, None), (3, None), (1, datetime(2022, 12, 31, 22, 59)), (1, datetime(2022, 12, 31, 23, 30))], "a int, f timestamp_ntz")
    lost = lambda p: [r.x for r in df.select(p.gives_up(F.col("a"), F.col("f"), NOW).alias("x")).collect()]
    assert lost(RetryPolicy("fixed", interval=1, max_attempts=3)) == [False, True, False, False]
    assert lost(RetryPolicy("fixed", interval=1, max_duration="1h")) == [False, False, True, False]
    assert lost(RetryPolicy("fixed", interval=1, max_attempts=-1)) == [False] * 4
    assert RetryPolicy().max_attempts == 5 and RetryPolicy(max_duration="1h").max_attempts is None


@pytest.mark.parametrize(
    "make",
    [
        lambda: RetryPolicy("odd"),
        lambda: RetryPolicy("linear"),
        lambda: RetryPolicy("exponential", max="1s"),
        lambda: RetryPolicy("series"),
        lambda: RetryPolicy("cron", expression="x"),
        lambda: RetryPolicy("fixed", interval=-1),
        lambda: RetryPolicy(max_attempts=0),
        lambda: CleanupPolicy("sometimes"),
        lambda: Evolution(on_upgrade="all"),
        lambda: Evolution(version=-1),
        lambda: TaskDefinition("", "s", "k"),
        lambda: TaskDefinition("t", "s", "k", debounce=-1),
        lambda: TaskDefinition("t", "s", "k", watch={"a": 0}),
        lambda: TaskDefinition("t", "s", "k", filter=[1]),
        lambda: Registry(TaskDefinition("t", "s", "k"), TaskDefinition("t", "s", "k")),
        lambda: parse_statuses("pending, odd"),
    ],
)
def test_definitions_that_are_errors(make):
    with pytest.raises(ValueError):
        make()


def test_registry_and_ids():
    a, b = TaskDefinition("a", "s", "k", {"x": 1}), TaskDefinition("b", "s", "k")
    r = Registry(a, b)
    assert r.get("a") is a and r.of_source("s") == [a, b] and r.sources() == ["s"]
    with pytest.raises(KeyError):
        r.get("c")
    assert TaskDefinition("t", "s", "k", {"a": 1, "b": 2}).signature() == TaskDefinition("t", "s", "k", {"b": 2, "a": 1}).signature()
    assert a.debounce == 1000 and a.cleanup == CleanupPolicy("source_deleted", 86_400_000) and a.history_limit == 5
    from pyspark.sql import types as T

    assert smart_ids("ABCDEF0123456789abcdef01", T.StringType()) == ["ABCDEF0123456789abcdef01", "abcdef0123456789abcdef01"]
    assert smart_ids("32", T.LongType()) == [32] and smart_ids("x", T.LongType()) == [] and smart_ids("1.5", T.DoubleType()) == [1.5]
    assert parse_statuses(" pending ,failed") == ["pending", "failed"]


@pytest.mark.parametrize(
    ("expression", "after", "expected"),
    [
        ("*/10 * * * *", datetime(2024, 11, 3, 6, 5), datetime(2024, 11, 3, 6, 10)),  # in the repeated hour
        ("*/10 * * * *", datetime(2024, 11, 3, 5, 55), datetime(2024, 11, 3, 6, 0)),  # into it
        ("*/10 * * * *", datetime(2024, 3, 10, 6, 55), datetime(2024, 3, 10, 7, 0)),  # over the hour that is left out
        ("30 2 * * *", datetime(2024, 3, 10, 6, 0), datetime(2024, 3, 10, 7, 30)),  # a time that is left out
        ("30 1 * * *", datetime(2024, 11, 3, 5, 30), datetime(2024, 11, 4, 6, 30)),  # a repeated time, once
        ("30 1 * * *", datetime(2024, 11, 3, 4, 30), datetime(2024, 11, 3, 5, 30)),
        ("0 3 * * *", datetime(2024, 7, 1, 12), datetime(2024, 7, 2, 7)),
    ],
)
def test_cron_when_clocks_change(expression, after, expected):
    assert Cron(expression, "America/New_York").next(after) == expected


@given(st.datetimes(datetime(2024, 1, 1), datetime(2025, 12, 31)), st.sampled_from(["*/10 * * * *", "30 2 * * *", "15 1-3 * * 0", "0 0 1 * *", "*/7 30 * * * *"]), st.sampled_from(["America/New_York", "Australia/Lord_Howe", "Europe/Berlin", "UTC"]))
@settings(max_examples=200, deadline=None)
def test_the_next_time_is_always_later(after, expression, tz):
    assert Cron(expression, tz).next(after) > after


def test_regular_expressions_keep_their_flags(spark):
    rows = spark.createDataFrame([("a\nB",), ("b",)], "s string")
    hit = lambda p: rows.filter(Filters(rows.schema).where({"s": p})).count()
    assert [hit(re.compile(x, f)) for x, f in (("^b", 0), ("^b", re.I), ("^b", re.I | re.M), ("a.B", 0), ("a.B", re.S))] == [1, 1, 2, 0, 1]


def test_operators_can_be_registered(spark):
    rows = spark.createDataFrame([(7, 2, " Ab ", datetime(2024, 5, 6, 7, 8, 9), [1.0, None, 3.0])], "a int, b int, s string, t timestamp_ntz, x array<double>")
    value = lambda e: rows.select(Filters(rows.schema).expression(e).alias("v")).first().v
    assert value({"$divide": ["$a", "$b"]}) == 3.5 and value({"$divide": ["$a", 0]}) is None and value({"$mod": ["$a", 4]}) == 3 and value({"$avg": "$x"}) == 2.0
    assert value({"$toUpper": "$s"}) == " AB " and value({"$trim": "$s"}) == "Ab" and value({"$concat": ["$s", "x"]}) == " Ab x" and value({"$toInt": "$s"}) is None
    assert [value({f"${k}": "$t"}) for k in ("year", "month", "dayOfMonth", "hour", "minute", "second")] == [2024, 5, 6, 7, 8, 9]
    with pytest.raises(ValueError):
        value({"$double": "$a"})
    register_operator("$double", lambda a: a * 2)
    assert value({"$double": "$a"}) == 14
    for name in ("double", "$double", "$add"):
        with pytest.raises(ValueError):
            register_operator(name, lambda a: a)


def test_trimming_and_rounding(spark):
    row = spark.createDataFrame([("\t\u00a0xaby \n", 2.5, 3.5, -0.125)], "s string, a double, b double, c double")
    value = lambda e: row.select(Filters(row.schema).expression(e).alias("v")).first().v
    assert value({"$trim": {"input": "$s"}}) == "xaby" and value({"$trim": "$s"}) == "xaby"
    assert value({"$ltrim": {"input": "$s"}}) == "xaby \n" and value({"$rtrim": {"input": "$s"}}) == "\t\u00a0xaby"
    assert value({"$trim": {"input": {"$trim": {"input": "$s"}}, "chars": "xy"}}) == "ab"
    assert (value({"$round": "$a"}), value({"$round": ["$b"]}), value({"$round": ["$c", 2]})) == (2.0, 4.0, -0.12)


def test_fields_of_variants(spark):
    """One order over all types; missing is not null; whole numbers beyond doubles."""
    texts = ["{}", '{"p": null}', '{"p": -3}', '{"p": 1.5}', '{"p": 9007199254740993}', '{"p": ""}', '{"p": "critical"}', '{"p": {"q": 1}}', '{"p": [1, "x"]}', '{"p": false}', '{"p": true}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.parse_json("t").alias("v"), F.struct(F.parse_json("t").alias("w")).alias("s"))
    got = lambda q: [r.i for r in rows.filter(Filters(rows.schema).where(q)).orderBy("i").collect()]
    assert got({"v.p": "critical"}) == [6] and got({"s.w.p": "critical"}) == [6] and got({"v.p": 1.5}) == [3] and got({"v.p": None}) == [1]
    assert got({"v.p": {"$gt": 1}}) == [3, 4, 5, 6, 7, 8, 9, 10] and got({"v.p": {"$lt": 1}}) == [0, 1, 2]
    assert got({"v.p": {"$gte": "a"}}) == [6, 7, 8, 9, 10] and got({"v.p": {"$lte": ""}}) == [0, 1, 2, 3, 4, 5]
    assert got({"v.p": {"$gt": 9007199254740992}}) == [4, 5, 6, 7, 8, 9, 10] and got({"v.p": 9007199254740992}) == []
    assert got({"v.p": {"$lt": True}}) == list(range(10)) and got({"v.p": {"$ne": None}}) == [0, *range(2, 11)]
    assert got({"v.p": {"$exists": False}}) == [0] and got({"v.p": {"$in": [None, True, "critical"]}}) == [1, 6, 10] and got({"v.p": {"$nin": [None, 1.5]}}) == [0, 2, *range(4, 11)]
    kinds = {"null": [1], "int": [2], "double": [3], "long": [4], "number": [2, 3, 4], "string": [5, 6], "object": [7], "array": [8], "bool": [9, 10]}
    assert {k: got({"v.p": {"$type": k}}) for k in kinds} == kinds
    assert got({"v.p": {"$size": 2}}) == [8] and got({"v.p.q": 1}) == [7] and got({"v.p.1": "x"}) == [8] and got({"v.p": {"$regex": "^CRIT", "$options": "i"}}) == [6]
    assert got({"$nor": [{"v.p": {"$gte": -3}}]}) == [0, 1]
    with pytest.raises(ValueError):
        got({"v.p": {"$type": "regex"}})
