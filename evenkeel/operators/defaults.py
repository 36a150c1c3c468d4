"""Filling absent fields from declared defaults."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default for a struct: present, with every field missing.
EMPTY: dict = {}


def apply_defaults(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """``{"path.to.field": value}``: a missing field takes the value, a given one wins.

    A missing parent struct stays missing, unless it has a default of its own (``EMPTY``).
    """
    tree: dict[str, Any] = {}
    for path, value in defaults.items():
        node = tree
        for part in path.split("."):
            node = node.setdefault("children", {}).setdefault(part, {})
        node["value"] = value
    tops = tree.get("children", {})
    return df.withColumns(
        {top: _fill(F.col(top), df.schema[top].dataType, node) for top, node in tops.items()}
    )


def _fill(column: Column, dtype: T.DataType, node: Mapping[str, Any]) -> Column:
    if "value" in node:
        column = F.coalesce(column, _literal(node["value"], dtype))
    children = node.get("children")
    if not children:
        return column
    unknown = set(children) - set(dtype.names)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    # The struct is built anew: a chain of withField calls would nest, and each of its steps
    # would repeat the ones before.
    fields = [
        (_fill(column[f.name], f.dataType, children[f.name]) if f.name in children else column[f.name]).alias(f.name)
        for f in dtype
    ]
    return F.when(column.isNotNull(), F.struct(*fields))


def _literal(value: Any, dtype: T.DataType) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(dtype, T.StructType):
        return F.struct(*[F.lit(value.get(f.name)).cast(f.dataType).alias(f.name) for f in dtype])
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value]).cast(dtype)
    return F.lit(value).cast(dtype)
