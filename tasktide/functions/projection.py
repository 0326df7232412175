"""What a task watches, as one struct: a change of the struct is a change of the row for that task."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import Filters


def watched(filters: Filters, projection: dict[str, Any] | None, schema: T.StructType) -> Column:
    """1 or True takes a field, 0 or False is an error, anything else is an expression; dotted names nest; nothing watches
    the whole row. Fields are sorted by name, so equal projections give equal structs whatever their order."""
    if not projection:
        return F.struct(*(F.col(filters.prefix + f.name).alias(f.name) for f in sorted(schema.fields, key=lambda f: f.name)))
    tree: dict[str, Any] = {}
    for path, value in projection.items():
        if value is False or (isinstance(value, int) and value == 0):
            raise ValueError(f"{path}: a watch projection can't exclude fields")
        *parents, leaf = path.split(".")
        at = tree
        for p in parents:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ValueError(f"{path}: {p} is watched as a whole")
        at[leaf] = filters.column(path) if value is True or (isinstance(value, int) and value == 1) else filters.expression(value)

    def struct(node: dict[str, Any]) -> Column:
        return F.struct(*((struct(v) if isinstance(v, dict) else v).alias(k) for k, v in sorted(node.items())))

    return struct(tree)
