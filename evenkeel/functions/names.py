"""Derived names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions._cols import ColumnLike, as_col


def blank_to_null(c: ColumnLike) -> Column:
    """An empty text means "not set"."""
    return F.nullif(as_col(c), F.lit(""))


def derived_name(name: ColumnLike, suffix: str = "") -> Column:
    """``{name}{suffix}``."""
    return F.concat(as_col(name), F.lit(suffix)) if suffix else as_col(name)


def derive_names(df: DataFrame, name: ColumnLike, suffixes: Mapping[str, str]) -> DataFrame:
    """Add one derived name per entry of ``{new column: suffix}``."""
    return df.withColumns({out: derived_name(name, s) for out, s in suffixes.items()})


def name_or_override(override: ColumnLike, default: ColumnLike) -> Column:
    """The given name when it is set, else the default."""
    return F.coalesce(blank_to_null(override), as_col(default))
