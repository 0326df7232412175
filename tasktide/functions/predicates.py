"""Document-style filters as Column expressions.

A filter is a dict: bare keys are field paths with a value or a dict of field operators, all of which have to hold; keys
with $ combine filters, or hold an expression ($expr). Predicates are total: they are true or false, never null. An
absent or null field is below every value, so $lt, $lte and $ne hold for it; strict_sql=True gives SQL's three values.
Fields within VARIANT columns may be missing, null or of any type (see variants.py). With `now` fixed, the result is a pure
function of a row. Catalyst pushes the resulting comparisons down to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from copy import copy
from datetime import datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .variants import VariantField, variant_path

#: Type names of $type and the Spark types they hold for.
TYPES = {
    "string": (T.StringType,),
    "int": (T.IntegerType, T.ShortType, T.ByteType),
    "long": (T.LongType,),
    "double": (T.DoubleType, T.FloatType),
    "number": (T.NumericType,),
    "bool": (T.BooleanType,),
    "date": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "array": (T.ArrayType,),
    "object": (T.StructType, T.MapType),
}
_FLAGS = {"i": re.I, "m": re.M, "s": re.S, "x": re.X}


def _flags(pattern: re.Pattern) -> str:
    """The options that a compiled pattern has."""
    return "".join(k for k, flag in _FLAGS.items() if pattern.flags & flag)


def field_type(schema: T.StructType | None, path: str) -> T.DataType | None:
    """The type at a dotted path; None if the schema has no such field."""
    kind: T.DataType | None = schema
    for name in path.split("."):
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        kind = next((f.dataType for f in kind.fields if f.name == name), None) if isinstance(kind, T.StructType) else None
    return kind


class Filters:
    """Compiler for rows of a schema. prefix rebases all field paths, as under the envelope of a change event."""

    def __init__(self, schema: T.StructType | None = None, now: datetime | Column | None = None, prefix: str = "", strict_sql: bool = False):
        self.schema, self.prefix, self.strict, self.bare = schema, prefix, strict_sql, False
        self.now = now if isinstance(now, Column) or now is None else F.lit(now).cast("timestamp_ntz")

    def column(self, path: str) -> Column:
        if self.schema is not None and field_type(self.schema, path) is None:
            return F.lit(None)
        return F.col(self.prefix + path)

    def _total(self, value: Column, absent: bool = False) -> Column:
        return value if self.strict or (self.bare and not absent) else F.coalesce(value, F.lit(absent))

    def _value(self, value: Any) -> Column:
        if isinstance(value, Column):
            return value
        if isinstance(value, dict):
            return F.struct(*(self._value(v).alias(k) for k, v in value.items()))
        if isinstance(value, (list, tuple)):
            return F.array(*map(self._value, value))
        return F.lit(value).cast("timestamp_ntz") if isinstance(value, datetime) else F.lit(value)

    def _check(self, path: str, value: Any) -> None:
        """Values of different kinds have no order or equality here: an error, where SQL would fail at run time."""
        kind = field_type(self.schema, path) if self.schema is not None else None
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if kind is not None and ((isinstance(kind, T.StringType) and number) or (isinstance(kind, T.NumericType) and isinstance(value, str))):
            raise ValueError(f"{path}: {kind.simpleString()} can't be compared with {value!r}")

    def compile(self, query: dict | None) -> Column:
        """The predicate of a filter; an empty one is true."""
        if query is not None and not isinstance(query, dict):
            raise ValueError(f"a filter is a dict, not {query!r}")
        parts = [self._part(k, v) for k, v in (query or {}).items()]
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def where(self, query: dict | None) -> Column:
        """The predicate for DataFrame.filter, where null is as good as false: what isn't negated stays a plain comparison,
        which reaches the scan."""
        plain = copy(self)
        plain.bare = True
        return plain.compile(query)

    def _negated(self) -> Filters:
        whole = copy(self)
        whole.bare = False
        return whole

    def _part(self, key: str, value: Any) -> Column:
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, (list, tuple)) or not value:
                raise ValueError(f"{key} takes a list of filters")
            parts = [(self._negated() if key == "$nor" else self).compile(v) for v in value]
            return reduce(lambda a, b: a & b, parts) if key == "$and" else reduce(lambda a, b: a | b, parts) if key == "$or" else ~reduce(lambda a, b: a | b, parts)
        if key == "$not":
            return ~self._negated().compile(value)
        if key == "$expr":
            return self._total(self.expression(value).cast("boolean"))
        if key.startswith("$"):
            raise ValueError(f"unsupported operator {key}")
        if isinstance(value, re.Pattern):
            return self._regex(key, value.pattern, _flags(value))
        if isinstance(value, dict) and value and all(k.startswith("$") for k in value):
            parts = [self._field(key, op, v, value) for op, v in value.items() if op != "$options"]
            return reduce(lambda a, b: a & b, parts)
        return self._field(key, "$eq", value, {})

    def _regex(self, path: str, pattern: str, options: str) -> Column:
        if set(options) - set(_FLAGS):
            raise ValueError(f"{path}: unsupported $options {options!r}")
        if inside := variant_path(self.schema, path):
            return VariantField(F.col(self.prefix + inside[0]), inside[1]).matches(f"(?{options}){pattern}" if options else pattern)
        return self._total(self.column(path).rlike(f"(?{options}){pattern}" if options else pattern))

    def _variant(self, field: VariantField, op: str, value: Any) -> Column:
        """A field operator on a field within a VARIANT column."""
        if op in ("$in", "$nin"):
            if not isinstance(value, (list, tuple)):
                raise ValueError(f"{field.path}: {op} takes a list")
            return field.among(list(value)) if op == "$in" else ~field.among(list(value))
        if op == "$exists":
            return field.exists() if value else ~field.exists()
        if op == "$type":
            return field.is_type(value)
        if op == "$size":
            return field.size(int(value))
        if op not in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"):
            raise ValueError(f"unsupported operator {op} on field {field.path}")
        return field.compare(op, value)

    def _field(self, path: str, op: str, value: Any, around: dict) -> Column:
        if op != "$regex" and (inside := variant_path(self.schema, path)):
            return self._variant(VariantField(F.col(self.prefix + inside[0]), inside[1]), op, value)
        col = self.column(path)
        if op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"):
            self._check(path, value)
            v = self._value(value)
            if value is None or isinstance(value, dict):
                same = col.eqNullSafe(v)
                if op in ("$eq", "$ne"):
                    return same if op == "$eq" else ~same
                raise ValueError(f"{path}: {op} needs a value with an order")
            made: dict[str, Callable[[], Column]] = {
                "$eq": lambda: self._total(col == v),
                "$ne": lambda: col != v if self.strict else ~col.eqNullSafe(v),
                "$gt": lambda: self._total(col > v),
                "$gte": lambda: self._total(col >= v),
                "$lt": lambda: self._total(col < v, True),
                "$lte": lambda: self._total(col <= v, True),
            }
            return made[op]()
        if op in ("$in", "$nin"):
            if not isinstance(value, (list, tuple)):
                raise ValueError(f"{path}: {op} takes a list")
            for v in value:
                self._check(path, v)
            known = [self._value(v) for v in value if v is not None]
            among = (self._negated() if op == "$nin" else self)._total(col.isin(known) if known else F.lit(False))
            among = among | col.isNull() if len(known) < len(value) else among
            return among if op == "$in" else ~among
        if op == "$exists":
            return col.isNotNull() if value else col.isNull()
        if op == "$regex":
            options = around.get("$options", "")
            return self._regex(path, value.pattern, options or _flags(value)) if isinstance(value, re.Pattern) else self._regex(path, value, options)
        if op == "$type":
            if value not in TYPES:
                raise ValueError(f"{path}: unknown type {value!r}")
            kind = field_type(self.schema, path) if self.schema is not None else None
            return col.isNotNull() & F.lit(isinstance(kind, TYPES[value]))
        if op == "$size":
            return self._total(F.size(col) == int(value))
        raise ValueError(f"unsupported operator {op} on field {path}")

    # Expressions: values computed from a row, as in $expr and computed watch fields.

    def expression(self, e: Any, names: dict[str, Column] | None = None) -> Column:
        names = names or {}
        if isinstance(e, str) and e.startswith("$$"):
            name, _, rest = e[2:].partition(".")
            if name == "NOW":
                if self.now is None:
                    raise ValueError("$$NOW needs a fixed time")
                return self.now
            if name == "ROOT":
                return self.column(rest)
            if name not in names:
                raise ValueError(f"unknown variable {e}")
            return reduce(lambda c, f: c[f], rest.split(".") if rest else [], names[name])
        if isinstance(e, str) and e.startswith("$"):
            return self.column(e[1:])
        if not isinstance(e, dict):
            return self._value([self.expression(x, names) for x in e] if isinstance(e, (list, tuple)) else e)
        if len(e) != 1 or not next(iter(e)).startswith("$"):
            return F.struct(*(self.expression(v, names).alias(k) for k, v in e.items()))
        (op, args), get = next(iter(e.items())), lambda x: self.expression(x, names)
        if op == "$literal":
            return self._value(args)
        if op in ("$filter", "$map", "$reduce"):
            array = get(args["input"])
            if op == "$reduce":
                return F.aggregate(array, get(args["initialValue"]), lambda a, x: self.expression(args["in"], names | {"value": a, "this": x}))
            name = args.get("as", "this")
            if op == "$filter":
                return F.filter(array, lambda x: F.coalesce(self.expression(args["cond"], names | {name: x}), F.lit(False)))
            return F.transform(array, lambda x: self.expression(args["in"], names | {name: x}))
        if op == "$regexMatch":
            options = args.get("options", "")
            return F.coalesce(get(args["input"]).rlike(f"(?{options}){args['regex']}" if options else args["regex"]), F.lit(False))
        if op == "$cond":
            test, yes, no = (args["if"], args["then"], args["else"]) if isinstance(args, dict) else args
            return F.when(get(test), get(yes)).otherwise(get(no))
        if op in _TRIMS and isinstance(args, dict) and "input" in args:
            return _TRIMS[op](get(args["input"]), get(args["chars"]) if "chars" in args else F.lit(_BLANKS))
        many = list(args) if isinstance(args, (list, tuple)) else [args]
        x = [get(a) for a in many]
        if op == "$add" and len(x) == 2 and isinstance(many[1], (int, float)) and self._is_time(many[0]):
            return x[0] + F.lit(timedelta(milliseconds=many[1]))
        if op == "$subtract" and self._is_time(many[0]) and self._is_time(many[1]):
            return F.timestamp_diff("MILLISECOND", x[1], x[0])
        if op == "$type":
            return self._type_name(many[0], x[0])
        if op not in _OPERATORS:
            raise ValueError(f"unsupported expression operator {op}")
        return _OPERATORS[op](*x)

    def _is_time(self, e: Any) -> bool:
        kind = field_type(self.schema, e[1:]) if self.schema is not None and isinstance(e, str) and e.startswith("$") else None
        return isinstance(kind, TYPES["date"]) or (isinstance(e, str) and e == "$$NOW") or isinstance(e, datetime)

    def _type_name(self, e: Any, value: Column) -> Column:
        kind = field_type(self.schema, e[1:]) if self.schema is not None and isinstance(e, str) else None
        name = next((n for n, kinds in TYPES.items() if n != "number" and isinstance(kind, kinds)), "unknown")
        return F.when(value.isNull(), "missing").otherwise(name)


def _max(*x: Column) -> Column:
    return F.array_max(x[0]) if len(x) == 1 else F.greatest(*x)


#: What is trimmed unless other characters are given: white space and the null character.
_BLANKS = "\0\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
_TRIMS: dict[str, Callable[[Column, Column], Column]] = {"$trim": F.btrim, "$ltrim": lambda a, c: F.ltrim(a, c), "$rtrim": lambda a, c: F.rtrim(a, c)}

#: Expression operators over evaluated arguments. Comparisons put absent values below all others.
_OPERATORS: dict[str, Callable[..., Column]] = {
    "$eq": lambda a, b: a.eqNullSafe(b),
    "$ne": lambda a, b: ~a.eqNullSafe(b),
    "$gt": lambda a, b: F.coalesce(a > b, a.isNotNull() & b.isNull()),
    "$gte": lambda a, b: F.coalesce(a >= b, b.isNull()),
    "$lt": lambda a, b: F.coalesce(a < b, a.isNull() & b.isNotNull()),
    "$lte": lambda a, b: F.coalesce(a <= b, a.isNull()),
    "$and": lambda *x: reduce(lambda a, b: a & b, x),
    "$or": lambda *x: reduce(lambda a, b: a | b, x),
    "$not": lambda a: ~a,
    "$in": lambda a, b: F.coalesce(F.array_contains(b, a), F.lit(False)),
    "$add": lambda *x: reduce(lambda a, b: a + b, x),
    "$subtract": lambda a, b: a - b,
    "$multiply": lambda *x: reduce(lambda a, b: a * b, x),
    "$max": _max,
    "$min": lambda *x: F.array_min(x[0]) if len(x) == 1 else F.least(*x),
    "$sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0))),
    "$ifNull": lambda *x: F.coalesce(*x),
    "$size": lambda a: F.size(F.coalesce(a, F.array())),
    "$setIntersection": lambda a, b: F.array_intersect(a, b),
    "$concatArrays": lambda *x: F.concat(*(F.coalesce(a, F.array()) for a in x)),
    "$arrayElemAt": lambda a, i: F.get(a, i),
    "$slice": lambda a, n: F.when(n >= 0, F.slice(a, F.lit(1), F.greatest(n, F.lit(0)))).otherwise(F.slice(a, F.greatest(F.lit(1), F.size(a) + n + 1), F.abs(n))),
}


def _date_part(name: str) -> Callable[[Column], Column]:
    return lambda a: F.date_part(F.lit(name), a).cast("int")


_OPERATORS |= {
    "$divide": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    "$mod": lambda a, b: F.try_mod(a, b),
    "$abs": F.abs,
    "$ceil": F.ceil,
    "$floor": F.floor,
    "$round": lambda a, n=None: F.bround(a, n if n is not None else 0),  # halves to the even
    "$avg": lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0))) / F.nullif(F.size(F.filter(a, lambda v: v.isNotNull())), F.lit(0)),
    "$concat": lambda *x: F.concat(*x),
    "$toLower": lambda a: F.lower(F.coalesce(a, F.lit(""))),
    "$toUpper": lambda a: F.upper(F.coalesce(a, F.lit(""))),
    **{op: (lambda a, trim=trim: trim(a, F.lit(_BLANKS))) for op, trim in _TRIMS.items()},
    "$strLenCP": F.length,
    "$toString": lambda a: a.cast("string"),
    "$toInt": lambda a: a.try_cast("int"),
    "$toDouble": lambda a: a.try_cast("double"),
    "$year": _date_part("YEAR"),
    "$month": _date_part("MONTH"),
    "$dayOfMonth": _date_part("DAY"),
    "$hour": _date_part("HOUR"),
    "$minute": _date_part("MINUTE"),
    "$second": _date_part("SECOND"),
}


def register_operator(name: str, make: Callable[..., Column]) -> None:
    """Add an expression operator: a function of evaluated argument Columns. A known name is an error."""
    if not name.startswith("$") or name in _OPERATORS:
        raise ValueError(f"can't register operator {name!r}")
    _OPERATORS[name] = make


FIELD_OPERATORS = frozenset("$eq $ne $gt $gte $lt $lte $in $nin $exists $regex $options $type $size".split())


def _is_query(f: Any) -> bool:
    """Whether a dict is a filter by its form; ValueError for a field with an unknown operator."""
    if not isinstance(f, dict):
        return False
    for key, value in f.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, (list, tuple)) or not all(map(_is_query, value)):
                return False
        elif key == "$not":
            if not _is_query(value):
                return False
        elif key != "$expr" and key.startswith("$"):
            return False
        elif key != "$expr" and isinstance(value, dict) and value and all(k.startswith("$") for k in value):
            if unknown := set(value) - FIELD_OPERATORS:
                raise ValueError(f"unsupported operator {sorted(unknown)[0]} on field {key}")
    return True


def normalize(task_filter: Any) -> dict:
    """A filter or bare expression as a filter dict: None and {} stay empty, a dict with only $ keys that is no filter is an
    expression. Needs no session; types are checked when the filter meets a schema."""
    if task_filter is None:
        return {}
    if isinstance(task_filter, Column):
        return {"$expr": task_filter}
    if not isinstance(task_filter, dict):
        raise ValueError(f"a filter is a dict, not {task_filter!r}")
    if _is_query(task_filter):
        return task_filter
    if any(not k.startswith("$") for k in task_filter):
        raise ValueError(f"fields can't stand beside an expression: {sorted(task_filter)}")
    return {"$expr": task_filter}
