"""One declared row to one row per expected child."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions._cols import ColumnLike, as_col, as_list


@dataclass(frozen=True)
class Child:
    """Kind, name and payload of one expected child; all payloads share one type."""

    kind: str
    name: ColumnLike
    payload: Column | None = None
    when: Column | None = None


def expand_children(
    df: DataFrame, templates: Sequence[Child], keep: str | Sequence[str] = ()
) -> DataFrame:
    """``keep`` columns plus (kind, child, payload), one row per template that applies.

    A single narrow pass: no union of one scan per kind.
    """
    rows = []
    for t in templates:
        payload = F.lit(None).cast("string") if t.payload is None else t.payload
        row = F.struct(
            F.lit(t.kind).alias("kind"), as_col(t.name).alias("child"), payload.alias("payload")
        )
        rows.append(row if t.when is None else F.when(t.when, row))
    items = F.array(*rows)
    if any(t.when is not None for t in templates):
        items = F.array_compact(items)
    return df.select(*as_list(keep), F.inline(items))
