"""Predicates over fields of VARIANT columns: rows without a declared schema, where a field may be missing, null, or of
another type in each row.

A missing field is not a null one. Values of all types are in one order: missing, null, numbers, texts, objects, arrays, true
and false, times; within a type by value. Comparisons are true or false, never null: what is of a type below the value's is
less, what is of one above is greater."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places of types in the order of values, missing being 0.
_NULL, _NUMBER, _TEXT, _OBJECT, _ARRAY, _BOOL, _TIME = range(1, 8)
_NAMES = {"string": _TEXT, "bool": _BOOL, "date": _TIME, "array": _ARRAY, "object": _OBJECT, "number": _NUMBER, "null": _NULL}


def variant_path(schema: T.StructType | None, path: str) -> tuple[str, str] | None:
    """The VARIANT column that a dotted path leads into, and the path within it; None if it doesn't."""
    kind: T.DataType | None = schema
    names = path.split(".")
    for i, name in enumerate(names):
        kind = next((f.dataType for f in kind.fields if f.name == name), None) if isinstance(kind, T.StructType) else None
        if isinstance(kind, T.VariantType):
            return ".".join(names[: i + 1]), "$" + "".join(f"[{n}]" if n.isdigit() else f"['{n}']" for n in names[i + 1 :])
    return None


class VariantField:
    """A field at a path within a VARIANT column."""

    def __init__(self, root: Column, path: str):
        self.root, self.path = root, path
        self.value = F.try_variant_get(root, path, "variant")
        self.kind = F.schema_of_variant(self.value)

    def read(self, kind: str) -> Column:
        """The value as a Spark type; null where it isn't one."""
        return F.try_variant_get(self.root, self.path, kind)

    def rank(self) -> Column:
        """The place of the value's type."""
        found = F.when(self.value.isNull(), 0).when(F.is_variant_null(self.value), _NULL).when(self.kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), _NUMBER).when(self.kind == "STRING", _TEXT)
        found = found.when(self.kind.startswith("OBJECT"), _OBJECT).when(self.kind.startswith("ARRAY"), _ARRAY).when(self.kind == "BOOLEAN", _BOOL)
        return found.otherwise(_TIME)

    def _against(self, value: Any) -> tuple[int, Column, Column]:
        """The place of a value's type, and the field and the value as that type."""
        if isinstance(value, bool):
            return _BOOL, self.read("boolean"), F.lit(value)
        if isinstance(value, int):  # whole numbers exactly, others as doubles
            return _NUMBER, F.when(self.kind == "BIGINT", F.signum(self.read("decimal(38,0)") - F.lit(value).cast("decimal(38,0)")).cast("double")).otherwise(self.read("double") - F.lit(float(value))), F.lit(0.0)
        if isinstance(value, float):
            return _NUMBER, self.read("double"), F.lit(value)
        if isinstance(value, str):
            return _TEXT, self.read("string"), F.lit(value)
        if isinstance(value, datetime):
            return _TIME, self.read("timestamp_ntz"), F.lit(value).cast("timestamp_ntz")
        raise ValueError(f"{self.path}: can't be compared with {value!r}")

    def compare(self, op: str, value: Any) -> Column:
        if value is None:
            rank, null = self.rank(), F.lit(_NULL)
            return {"$eq": rank == null, "$ne": rank != null, "$gt": rank > null, "$gte": rank >= null, "$lt": rank < null, "$lte": rank <= null}[op]
        place, mine, other = self._against(value)
        rank = self.rank()
        same = lambda test: (rank == place) & F.coalesce(test, F.lit(False))
        if op == "$eq":
            return same(mine == other)
        if op == "$ne":
            return ~same(mine == other)
        if op in ("$gt", "$gte"):
            return (rank > place) | same(mine > other if op == "$gt" else mine >= other)
        return (rank < place) | same(mine < other if op == "$lt" else mine <= other)

    def among(self, values: list[Any]) -> Column:
        out = F.lit(False)
        for v in values:
            out = out | self.compare("$eq", v)
        return out

    def exists(self) -> Column:
        return self.value.isNotNull()

    def is_type(self, name: str) -> Column:
        """int and long are whole numbers of up to 32 and of more bits, double and decimal are others."""
        rank, whole = self.rank(), self.kind == "BIGINT"
        small = F.coalesce(self.read("decimal(38,0)").between(-(2**31), 2**31 - 1), F.lit(False))
        if name in ("int", "long"):
            return (rank == _NUMBER) & whole & (small if name == "int" else ~small)
        if name == "double":
            return (rank == _NUMBER) & ~whole
        if name not in _NAMES:
            raise ValueError(f"{self.path}: unknown type {name!r}")
        return rank == _NAMES[name]

    def size(self, n: int) -> Column:
        return (self.rank() == _ARRAY) & F.coalesce(F.size(self.read("array<variant>")) == n, F.lit(False))

    def matches(self, pattern: str) -> Column:
        return (self.rank() == _TEXT) & F.coalesce(self.read("string").rlike(pattern), F.lit(False))
