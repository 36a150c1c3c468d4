"""Typed reading of text values and merging of errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.functions._cols import ColumnLike, as_col

BAD_VALUE = "BAD_VALUE"


def typed_value(text: ColumnLike, type_name: str) -> Column:
    """The text as int, boolean and so on; null when it cannot be read.

    Accepted spellings are those of Spark's cast.
    """
    return as_col(text).try_cast(type_name)


def typed_error(text: ColumnLike, type_name: str) -> Column:
    """BAD_VALUE when a given text cannot be read as the type, else null."""
    value = as_col(text)
    return F.when(value.isNotNull() & value.try_cast(type_name).isNull(), F.lit(BAD_VALUE))


def collect_errors(*errors: ColumnLike) -> Column:
    """The errors that are set, in order; an empty list means no error."""
    return F.array_compact(F.array(*[as_col(e) for e in errors]))
