"""Ordered list functions on array columns. A missing list counts as an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.functions._cols import ColumnLike, as_col


def _or_empty(a: ColumnLike) -> Column:
    return F.coalesce(as_col(a), F.array())


def array_minus(a: ColumnLike, b: ColumnLike) -> Column:
    """Items of ``a`` that are not in ``b``; order and duplicates of ``a`` are kept.

    ``array_except`` looks items up by hash but drops duplicates, so it serves where ``a`` has
    none; otherwise each item is looked up in the sorted ``b`` by halving. A null is an item like
    any other.
    """
    left = _or_empty(a)
    right = F.concat(_or_empty(b), F.slice(left, 1, 0))  # nothing is added; both sides get one type
    return F.when(F.size(F.array_distinct(left)) == F.size(left), F.array_except(left, right)).otherwise(_minus_sorted(left, right))


def _minus_sorted(left: Column, right: Column) -> Column:
    """Each item of ``left`` against ``right``, which is sorted once per row: the lambda that takes
    the struct is there to hold what would else be computed for each item."""
    items = F.array_compact(right)
    held = F.struct(
        left.alias("left"),
        F.sort_array(items).alias("sorted"),
        F.transform(F.sequence(F.length(F.bin(F.size(items))) - 1, F.lit(0), F.lit(-1)), lambda k: F.pow(2, k).cast("int")).alias("strides"),
        F.exists(right, lambda y: y.isNull()).alias("has_null"),
    )

    def found(s: Column, x: Column) -> Column:
        def further(at, stride):
            up = at + stride
            return F.when((up <= F.size(s["sorted"])) & (F.get(s["sorted"], up - 1) <= x), up).otherwise(at)

        not_above = F.aggregate(s["strides"], F.lit(0), further)
        return F.when(x.isNull(), s["has_null"]).otherwise(F.coalesce(F.get(s["sorted"], not_above - 1) == x, F.lit(False)))

    return F.get(F.transform(F.array(held), lambda s: F.filter(s["left"], lambda x: ~found(s, x))), F.lit(0))


def has_missing(a: ColumnLike, b: ColumnLike) -> Column:
    """Whether ``array_minus(a, b)`` would have items."""
    return F.size(F.array_except(_or_empty(a), _or_empty(b))) > 0


def array_dedup(a: ColumnLike) -> Column:
    """First occurrence of each item, in order."""
    return F.array_distinct(as_col(a))


def join_items(a: ColumnLike, separator: str = ",") -> Column:
    """Items as one text, without a trailing separator."""
    return F.array_join(as_col(a), separator)


def append_list(a: ColumnLike, b: ColumnLike) -> Column:
    """``b`` put after ``a``; nothing is replaced or deduplicated."""
    return F.concat(_or_empty(a), _or_empty(b))


def append_args(command: ColumnLike, *args: ColumnLike | int | bool) -> Column:
    """A command list followed by fixed arguments; plain strings are literals here."""
    tail = [a if isinstance(a, Column) else F.lit(str(a)) for a in args]
    return F.concat(_or_empty(command), F.array(*tail))
