"""Queries over filters: one for each kind of predicate and expression."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import functions as F

from ..functions.predicates import Filters
from .registry import add
from .sample_state import NOW, SQL_NOW, table

#: name: (table, key, filter, the same as a condition in SQL)
CASES = {
    "filter_empty": ("nation", "n_nationkey", {}, "TRUE"),
    "filter_eq": ("orders", "o_orderkey", {"o_orderstatus": "F"}, "o_orderstatus = 'F'"),
    "filter_implicit_and": ("orders", "o_orderkey", {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}, "o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"),
    "filter_and_range": ("orders", "o_orderkey", {"$and": [{"o_totalprice": {"$gte": 1000, "$lt": 200000}}, {"o_orderstatus": {"$ne": "P"}}]}, "o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderstatus <> 'P'"),
    "filter_or": ("orders", "o_orderkey", {"$or": [{"o_orderstatus": "P"}, {"o_orderstatus": "O", "o_totalprice": {"$gt": 300000}}]}, "o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_totalprice > 300000)"),
    "filter_nor": ("orders", "o_orderkey", {"$nor": [{"o_orderstatus": "P"}, {"o_totalprice": {"$lte": 100000}}]}, "NOT (o_orderstatus = 'P' OR o_totalprice <= 100000)"),
    "filter_not": ("customer", "c_custkey", {"$not": {"c_mktsegment": "BUILDING"}}, "c_mktsegment <> 'BUILDING'"),
    "filter_in": ("customer", "c_custkey", {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY", None]}}, "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "filter_nin": ("customer", "c_custkey", {"c_mktsegment": {"$nin": ["BUILDING"]}}, "c_mktsegment NOT IN ('BUILDING')"),
    "filter_regex": ("part", "p_partkey", {"p_type": re.compile("^promo", re.I)}, "regexp_matches(p_type, '^promo', 'i')"),
    "filter_regex_options": ("part", "p_partkey", {"p_brand": {"$regex": "brand#[12]", "$options": "i"}}, "regexp_matches(p_brand, 'brand#[12]', 'i')"),
    "filter_now": ("orders", "o_orderkey", {"$expr": {"$lt": ["$o_orderdate", "$$NOW"]}}, f"o_orderdate < {SQL_NOW}"),
    "filter_date_add": ("lineitem", "l_orderkey", {"$expr": {"$lt": [{"$add": ["$l_shipdate", 86400000]}, "$$NOW"]}}, f"l_shipdate + INTERVAL 1 DAY < {SQL_NOW}"),
    "filter_date_value": ("orders", "o_orderkey", {"o_orderdate": {"$gte": datetime(1996, 1, 1)}}, "o_orderdate >= TIMESTAMP '1996-01-01'"),
    "filter_regex_literal_flags": ("part", "p_partkey", {"p_type": re.compile("^[es].*(my|ll)$", re.I | re.S)}, "regexp_matches(p_type, '^[es].*(my|ll)$', 'is')"),
    "filter_string_operators": ("part", "p_partkey", {"$expr": {"$and": [{"$eq": [{"$toLower": "$p_brand"}, "brand#13"]}, {"$gt": [{"$strLenCP": {"$trim": {"input": "$p_type", "chars": "EY"}}}, 4]}]}}, "lower(p_brand) = 'brand#13' AND length(trim(p_type, 'EY')) > 4"),
    "filter_round": ("lineitem", "l_orderkey", {"$expr": {"$eq": [{"$mod": [{"$round": [{"$divide": ["$l_quantity", 2]}]}, 2]}, 0]}}, "round_even(l_quantity / 2, 0) % 2 = 0"),
    "filter_date_operators": ("orders", "o_orderkey", {"$expr": {"$and": [{"$eq": [{"$year": "$o_orderdate"}, 1996]}, {"$lt": [{"$mod": ["$o_orderkey", 7]}, 3]}]}}, "year(o_orderdate) = 1996 AND o_orderkey % 7 < 3"),
    "filter_division": ("lineitem", "l_orderkey", {"$expr": {"$gt": [{"$divide": ["$l_extendedprice", "$l_quantity"]}, 1500]}}, "l_extendedprice / l_quantity > 1500"),
    "filter_field_to_field": ("lineitem", "l_orderkey", {"$expr": {"$gt": ["$l_discount", "$l_tax"]}}, "l_discount > l_tax"),
    "filter_arithmetic": ("lineitem", "l_orderkey", {"$expr": {"$gt": [{"$multiply": ["$l_linenumber", 10]}, "$l_quantity"]}}, "l_linenumber * 10 > l_quantity"),
    "filter_type": ("orders", "o_orderkey", {"o_orderkey": {"$type": "long"}}, "TRUE"),
}

#: The same over nullable fields: (filter, condition) on key k and optional fields a (a number), s (text).
NULLABLE = {
    "filter_ne_nullsafe": ({"a": {"$ne": 2}}, "a IS DISTINCT FROM 2"),
    "filter_lt_absent": ({"a": {"$lt": 3}}, "a IS NULL OR a < 3"),
    "filter_lte_absent": ({"a": {"$lte": 3}}, "a IS NULL OR a <= 3"),
    "filter_gt_absent": ({"a": {"$gt": 3}}, "a IS NOT NULL AND a > 3"),
    "filter_exists": ({"a": {"$exists": True}, "s": {"$exists": False}}, "a IS NOT NULL AND s IS NULL"),
    "filter_null": ({"s": None}, "s IS NULL"),
    "filter_not_null_regex": ({"$nor": [{"s": {"$regex": "^F"}}]}, "NOT coalesce(s LIKE 'F%', FALSE)"),
    "filter_expr_missing": ({"$expr": {"$eq": [{"$type": "$a"}, "missing"]}}, "a IS NULL"),
    "filter_in_null": ({"s": {"$in": ["F", None]}}, "s IS NULL OR s = 'F'"),
}

#: Over nested fields: structs meta (kind, size) and pair (kind, urgency), and arrays tags and items of structs.
NESTED = {
    "filter_dotted": ({"meta.kind": "F", "meta.size": {"$gt": 1000}}, "o_orderstatus = 'F' AND o_totalprice > 1000"),
    "filter_struct_eq": ({"pair": {"kind": "F", "urgency": "1-URGENT"}}, "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "filter_array_size": ({"tags": {"$size": 2}}, "o_orderstatus <> 'P'"),
    "filter_intersection": ({"$expr": {"$gt": [{"$size": {"$setIntersection": ["$tags", ["O", "1-URGENT"]]}}, 0]}}, "o_orderstatus = 'O' OR (o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT')"),
    "filter_elements": ({"$expr": {"$gt": [{"$size": {"$filter": {"input": "$items", "as": "i", "cond": {"$and": [{"$eq": ["$$i.what", "F"]}, {"$gt": ["$$i.n", 5]}]}}}}, 0]}}, "o_orderstatus = 'F' AND o_orderkey % 10 > 5"),
    "filter_regex_match": ({"$expr": {"$regexMatch": {"input": "$meta.kind", "regex": "^[FO]$"}}}, "o_orderstatus IN ('F', 'O')"),
    "filter_expr_in": ({"$expr": {"$in": ["P", "$tags"]}}, "o_orderstatus = 'P'"),
}


#: Over a VARIANT column: props.k is a text for purchases, null for errors, missing for signups, a number for other events. In
#: SQL n is the number and s the text, null where there is none.
VARIANT = {
    "variant_gt": ({"props.k": {"$gt": 50}}, "n > 50 OR s IS NOT NULL"),
    "variant_lte": ({"props.k": {"$lte": 50}}, "n <= 50 OR event_type IN ('error', 'signup')"),
    "variant_lt_text": ({"props.k": {"$lt": "5"}}, "s < '5' OR s IS NULL"),
    "variant_in": ({"props.k": {"$in": [7, 8, "9", None]}}, "n IN (7, 8) OR s = '9' OR event_type = 'error'"),
    "variant_ne": ({"props.k": {"$ne": 7}}, "n IS DISTINCT FROM 7"),
    "variant_exists": ({"props.k": {"$exists": True}}, "event_type <> 'signup'"),
    "variant_missing": ({"props.k": {"$exists": False}, "props.other.deep": {"$exists": False}}, "event_type = 'signup'"),
    "variant_type": ({"$or": [{"props.k": {"$type": "string"}}, {"props.k": {"$type": "null"}}]}, "event_type IN ('purchase', 'error')"),
    "variant_regex": ({"props.k": {"$regex": "^[1-3]"}}, "regexp_matches(s, '^[1-3]')"),
}


def variant(spark, sf_dir):
    number = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_type") == "purchase", F.concat(F.lit('{"k": "'), number, F.lit('"}'))).when(F.col("event_type") == "error", '{"k": null}').when(F.col("event_type") == "signup", "{}").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), "event_type", F.parse_json(text).alias("props"))


def nullable(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 3 != 0, k % 5).alias("a"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("s"))


def nested(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tags = F.when(F.col("o_orderstatus") == "P", F.array("o_orderstatus")).otherwise(F.array("o_orderstatus", "o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("k"), F.struct(F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("size")).alias("meta"), F.struct(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("urgency")).alias("pair"), tags.alias("tags"), F.array(F.struct(F.col("o_orderstatus").alias("what"), (F.col("o_orderkey") % 10).alias("n"))).alias("items"))


def _add(name, rows, key, task_filter, sql):
    def run(spark, sf_dir):
        source = rows(spark, sf_dir)
        return source.filter(Filters(source.schema, NOW).where(task_filter)).select(F.col(key).cast("long").alias("k"))

    run.__doc__ = f"Rows that match {task_filter!r}."
    add(name, run, sql)


for _name, (_table, _key, _filter, _sql) in CASES.items():
    _add(_name, lambda spark, sf_dir, t=_table: table(spark, sf_dir, t), _key, _filter, f"SELECT CAST({_key} AS BIGINT) AS k FROM {_table} WHERE {_sql}")
for _name, (_filter, _sql) in NULLABLE.items():
    _add(_name, nullable, "k", _filter, f"WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 END AS a, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS s FROM orders) SELECT k FROM t WHERE {_sql}")
for _name, (_filter, _sql) in NESTED.items():
    _add(_name, nested, "k", _filter, f"SELECT o_orderkey AS k FROM orders WHERE {_sql}")
for _name, (_filter, _sql) in VARIANT.items():
    _k = "json_extract_string(props, '$.k')"
    _t = f"SELECT event_id AS k, event_type, CASE WHEN event_type NOT IN ('purchase', 'error', 'signup') THEN CAST({_k} AS BIGINT) END AS n, CASE event_type WHEN 'purchase' THEN {_k} END AS s FROM events"
    _add(f"filter_{_name}", variant, "k", _filter, f"WITH t AS ({_t}) SELECT k FROM t WHERE {_sql}")


def prefixed(spark, sf_dir):
    """A filter rebased under a change event's envelope."""
    o = table(spark, sf_dir, "orders")
    events = o.select(F.struct(*o.columns).alias("full_document"))
    return events.filter(Filters(o.schema, NOW, prefix="full_document.").compile({"o_orderstatus": "F", "$expr": {"$gt": ["$o_totalprice", 1000]}})).select(F.col("full_document.o_orderkey").alias("k"))


add("filter_prefixed", prefixed, "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
