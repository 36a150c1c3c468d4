"""Content comparison for map and scalar columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.functions._cols import ColumnLike, as_col


def _entries(m: ColumnLike) -> Column:
    return F.sort_array(F.map_entries(F.coalesce(as_col(m), F.create_map())))


def maps_equal(a: ColumnLike, b: ColumnLike) -> Column:
    """Same keys with the same values, in any order; a missing map equals an empty one."""
    return _entries(a).eqNullSafe(_entries(b))


def value_changed(before: ColumnLike, after: ColumnLike) -> Column:
    """Null-safe difference of two comparable values."""
    return ~as_col(before).eqNullSafe(as_col(after))


def content_changed(
    pairs: Sequence[tuple[ColumnLike, ColumnLike]], maps: Sequence[tuple[ColumnLike, ColumnLike]] = ()
) -> Column:
    """True when any (before, after) pair differs; map columns go in ``maps``."""
    out = F.lit(False)
    for before, after in pairs:
        out = out | value_changed(before, after)
    for before, after in maps:
        out = out | ~maps_equal(before, after)
    return out
