"""Row validation against declared constraints.

A rule is a (name, Column) pair whose column is true where the row breaks it. Except for
``required``, a missing value breaks no rule.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions._cols import ColumnLike, as_col

Rule = tuple[str, Column]


def _named(kind: str, column: ColumnLike, broken: Callable[[Column], Column], name: str | None) -> Rule:
    label = name or (f"{column}:{kind}" if isinstance(column, str) else kind)
    return label, broken(as_col(column))


def required(column: ColumnLike, name: str | None = None) -> Rule:
    return _named("required", column, lambda c: c.isNull(), name)


def required_with(column: ColumnLike, other: ColumnLike, name: str | None = None) -> Rule:
    """``column`` must be given where ``other`` is."""
    return _named("required", column, lambda c: as_col(other).isNotNull() & c.isNull(), name)


def minimum(column: ColumnLike, least: float | int, name: str | None = None) -> Rule:
    return _named("minimum", column, lambda c: c < F.lit(least), name)


def min_items(column: ColumnLike, least: int, name: str | None = None) -> Rule:
    return _named("min_items", column, lambda c: F.size(c) < F.lit(least), name)


def unique_items(column: ColumnLike, name: str | None = None) -> Rule:
    return _named("unique", column, lambda c: F.size(F.array_distinct(c)) < F.size(c), name)


def one_of(column: ColumnLike, allowed: Sequence, name: str | None = None) -> Rule:
    return _named("enum", column, lambda c: ~c.isin(*allowed), name)


def length_between(
    column: ColumnLike, least: int | None = None, most: int | None = None, name: str | None = None
) -> Rule:
    def broken(c: Column) -> Column:
        out = F.lit(False)
        if least is not None:
            out = out | (F.char_length(c) < F.lit(least))
        if most is not None:
            out = out | (F.char_length(c) > F.lit(most))
        return out

    return _named("length", column, broken, name)


def matches(column: ColumnLike, pattern: str, name: str | None = None) -> Rule:
    """The whole text must match ``pattern``, which is given without anchors."""
    return _named("pattern", column, lambda c: ~c.rlike(_whole(pattern)), name)


def items_match(column: ColumnLike, pattern: str, name: str | None = None) -> Rule:
    """Each item as a whole must match ``pattern``, which is given without anchors."""
    whole = _whole(pattern)
    return _named("item_pattern", column, lambda c: F.exists(c, lambda x: ~x.rlike(whole)), name)


def items_satisfy(column: ColumnLike, broken: Callable[[Column], Column], name: str) -> Rule:
    """Some item of a list of structs breaks ``broken(item)``."""
    return _named(
        name, column, lambda c: F.exists(c, lambda x: F.coalesce(broken(x), F.lit(False))), name
    )


def _whole(pattern: str) -> str:
    # "$" would also accept a final newline.
    return rf"\A(?:{pattern})\z"


def violations(rules: Sequence[Rule]) -> Column:
    """Names of the broken rules, in rule order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def validate(df: DataFrame, rules: Sequence[Rule], into: str = "violations") -> DataFrame:
    """Add the names of the broken rules; an empty list means the row is accepted."""
    return df.withColumn(into, violations(rules))


def split_valid(
    df: DataFrame, rules: Sequence[Rule], into: str = "violations"
) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with the names of their broken rules)."""
    checked = validate(df, rules, into)
    return checked.filter(F.size(into) == 0).drop(into), checked.filter(F.size(into) > 0)
