"""Fixed-order text from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.functions._cols import ColumnLike, as_col


def line(prefix: str, value: ColumnLike, when: Column | None = None) -> Column:
    """``{prefix}{value}``; the line is left out where ``when`` does not hold.

    Booleans read true / false; a missing value leaves the text after the prefix empty.
    """
    text = F.concat(F.lit(prefix), F.coalesce(as_col(value).cast("string"), F.lit("")))
    return text if when is None else F.when(when, text)


def render_config(*lines: Column | str) -> Column:
    """Lines joined by newlines, with one at the end. Plain strings are literal lines."""
    parts = [F.lit(p) if isinstance(p, str) else p for p in lines]
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n"))
