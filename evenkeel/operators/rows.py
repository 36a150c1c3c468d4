"""Row-level set operations that keep duplicates and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions._cols import as_list
from evenkeel.operators.skew import null_spread


def rows_minus(a: DataFrame, b: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``; duplicates in ``a`` are kept.

    Not ``EXCEPT``, which deduplicates, nor ``EXCEPT ALL``, which subtracts counts. Rows of
    ``a`` with a null key are kept and are spread over the tasks.
    """
    keys = as_list(keys)
    spread = null_spread([F.col(k) for k in keys], [F.col(c) for c in _hashable(a)])
    # Deduplicating b first would stop adaptive execution from splitting a hot key of a.
    other = b.select(*keys).withColumn("_spread", F.lit(0))
    return (
        a.withColumn("_spread", spread).join(other, [*keys, "_spread"], "left_anti").drop("_spread")
        .select(*a.columns)
    )


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]


def rows_dedup(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """First row of each key in the given order, which should be unique within a key.

    The ``= 1`` filter lets Spark keep one row per key and task before the shuffle, so a hot
    key costs no more than a rare one.
    """
    w = Window.partitionBy(*as_list(keys)).orderBy(*as_list(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


SLICES = 16


def slice_cuts(rows: DataFrame, order: str | Sequence[str], slices: int = SLICES) -> list:
    """Quantiles of the first order column, a number or a time (in microseconds), over all rows."""
    if slices < 2:
        return []
    at = _number(rows, as_list(order)[0])
    found = rows.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 1000)).first()[0]
    return sorted(set(found or []))


def _number(rows: DataFrame, name: str) -> Column:
    kind = rows.schema[name].dataType.typeName()
    return F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith("timestamp") else F.col(name)


def sliced(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: Sequence) -> DataFrame:
    """``rows`` with ``_key``, a struct that is never null, and ``_slice``, which grows with the order.

    A hot key's rows are in as many groups (_key, _slice) as there are slices, whatever adaptive
    execution does; only rows of one key and one instant have to meet. Null times come first.
    """
    at = _number(rows, order[0])
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= at)) if cuts else F.lit(0)
    return rows.withColumns({"_key": F.struct(*keys), "_slice": F.when(F.col(order[0]).isNull(), -1).otherwise(place)})


def with_previous(
    rows: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], values: Sequence[str], cuts: Sequence | None = None
) -> DataFrame:
    """``rows`` with ``_prev``: a struct of ``values`` of the key's previous row, null for its first.

    ``order`` must be unique within a key; null keys are a key. Rows are compared within their
    slice of the order (see ``sliced``; ``cuts`` are measured where they are not given), and the
    last row of each slice, one per key and slice, is handed on to the next.
    """
    keys, order = as_list(keys), as_list(order)
    named = sliced(rows, keys, order, slice_cuts(rows, order) if cuts is None else cuts)
    own = F.struct(*values)
    w = Window.partitionBy("_key", "_slice").orderBy(*order)
    marked = named.withColumns({"_prev": F.lag(own).over(w), "_next": F.lead(F.lit(1)).over(w)})
    ends = marked.filter("_next IS NULL").select("_key", "_slice", F.lag(own).over(Window.partitionBy("_key").orderBy("_slice")).alias("_seam"))
    out = marked.join(ends, ["_key", "_slice"], "left")
    return out.select(*rows.columns, F.coalesce("_prev", "_seam").alias("_prev"))


def last_runs(
    rows: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], status: str, at: str, values: Sequence[str], cuts: Sequence | None = None
) -> DataFrame:
    """(keys, ``values`` of the last row, ``_since``): ``at`` of the first row of the key's last run
    of equal ``status``.

    From a summary per key and slice of the order (see ``sliced``): its first status, its last row,
    and its last change. The summaries, a few per key, are then folded in their order.
    """
    keys, order = as_list(keys), as_list(order)
    named = sliced(rows, keys, order, slice_cuts(rows, order) if cuts is None else cuts)
    w = Window.partitionBy("_key", "_slice").orderBy(*order)
    before = F.lag(F.struct(status)).over(w)
    marked = named.withColumn("_before", before)
    moved = F.col("_before").isNotNull() & ~F.col(f"_before.{status}").eqNullSafe(F.col(status))
    place = F.struct(*order)
    parts = marked.groupBy("_key", "_slice").agg(
        F.min_by(F.struct(F.col(status).alias("status"), F.col(at).alias("at")), place).alias("_first"),
        F.max_by(F.struct(F.col(status).alias("_status"), *values), place).alias("_last"),
        F.max(F.when(moved, F.struct(*order, F.col(at).alias("_at")))).alias("_change"),
    )
    along = Window.partitionBy("_key").orderBy("_slice")
    earlier = F.lag("_last").over(along)
    joined = parts.withColumn("_earlier", earlier)
    begins = F.col("_earlier").isNull() | ~F.col("_earlier._status").eqNullSafe(F.col("_first.status"))
    # A struct around the time: a slice without a change is null, a change at a null time is not.
    since = F.when(F.col("_change").isNotNull(), F.struct(F.col("_change._at").alias("at"))).when(begins, F.struct(F.col("_first.at").alias("at")))
    ends = joined.withColumn("_since", since).groupBy("_key").agg(
        F.max_by("_last", "_slice").alias("_last"), F.max_by("_since", F.when(F.col("_since").isNotNull(), F.col("_slice"))).alias("_since")
    )
    return ends.select(*(F.col(f"_key.{k}").alias(k) for k in keys), *(F.col(f"_last.{v}").alias(v) for v in values), F.col("_since.at").alias("_since"))


def distinct_requests(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """At most one request per object."""
    return df.select(*as_list(keys)).distinct()
