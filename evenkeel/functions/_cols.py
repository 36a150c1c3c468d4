"""Small shared helpers for column arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    """A name becomes a column reference, a Column stays as it is."""
    return F.col(c) if isinstance(c, str) else c


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def order_value(order: Sequence[str]) -> Column:
    """One comparable value for an order given by several columns.

    A single column is used as it is, so that a fixed-width one can be aggregated by hash.
    """
    names = as_list(order)
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)
