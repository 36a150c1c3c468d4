"""Shared pieces of the streams that compare a micro-batch with the last row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.sources.versions import RowVersions

COMPACT_EVERY = 50  # micro-batches


def state_table(stream: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str], more: Sequence[T.StructField] = ()) -> RowVersions:
    """The table of last rows: some columns of the stream, and more."""
    kinds = [T.StructField(c, stream.schema[c].dataType) for c in [*keys, *columns]]
    return RowVersions(stream.sparkSession, path, keys, T.StructType([*kinds, *more]))


def last_rows(state: RowVersions, batch: DataFrame, order: Sequence[str], batch_id: int) -> DataFrame:
    """What was kept of the keys of ``batch`` before this micro-batch: the latest row of each."""
    keys = state.keys
    seen = state.history(batch_id).withColumn("_key", F.struct(*keys)).join(batch.select(F.struct(*keys).alias("_key")), "_key", "left_semi")
    more = [c for c in state.columns if c not in keys and c not in order]
    latest = seen.groupBy("_key").agg(F.max(F.struct(*order, *more)).alias("_row"))
    return latest.select(*(F.col(f"_key.{k}").alias(k) for k in keys), "_row.*")


def parted(rows: DataFrame, before: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``_when``: 1 after the key's last row ``before``, -1 before it; a replay of that
    row itself is left out. Null keys are a key like any other."""
    last = before.select(F.struct(*keys).alias("_key"), F.struct(*order).alias("_last"))
    own = F.struct(*order)
    when = F.when(F.col("_last").isNull() | (own > F.col("_last")), 1).when(own < F.col("_last"), -1)
    joined = rows.withColumn("_key", F.struct(*keys)).join(last, "_key", "left").withColumn("_when", when)
    return joined.filter("_when IS NOT NULL").drop("_key", "_last")


def keep_state(state: RowVersions, rows: DataFrame, batch_id: int) -> None:
    """Write the last rows of this micro-batch, and now and then the whole table."""
    state.write(rows, batch_id)
    if (batch_id + 1) % COMPACT_EVERY == 0:
        state.compact(batch_id)
        state.trim()
