"""Condition logs: the current row per condition and the time of its last transition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions._cols import as_list, order_value
from evenkeel.operators.rows import last_runs, rows_dedup


def current_conditions(
    log: DataFrame,
    keys: Sequence[str] = ("namespace", "object", "type"),
    order: Sequence[str] = ("ts", "seq"),
    values: Sequence[str] = ("status", "reason", "message"),
) -> DataFrame:
    """Latest values per key; a later write wins, ``order`` must be unique within a key.

    Aggregates before the shuffle: one row per key and task is moved.
    """
    latest = F.max_by(F.struct(*values), order_value(order)).alias("_latest")
    return log.groupBy(*keys).agg(latest).select(*keys, "_latest.*")


def condition_transitions(
    log: DataFrame,
    keys: Sequence[str] = ("namespace", "object", "type"),
    order: Sequence[str] = ("ts", "seq"),
    status: str = "status",
    at: str = "ts",
) -> DataFrame:
    """(keys, status, last_transition_time): the time moves only when the status changes.

    The log is moved once, by key and slice of its order, so a hot key is worked on by several
    tasks without help from adaptive execution (see ``last_runs``). The first order column is a
    number or a time; its quantiles are measured by a scan of that column.
    """
    keys = as_list(keys)
    names = [*keys, *as_list(order)]
    rows = log.select(*names, F.col(status).alias("status_now"), F.col(at).alias("_moment"))
    found = last_runs(rows, keys, order, "status_now", "_moment", ["status_now"])
    return found.select(*keys, F.col("status_now").alias("status"), F.col("_since").alias("last_transition_time"))


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole latest row per key, for logs that an update-mode stream wrote."""
    return rows_dedup(df, keys, [F.desc(c) for c in as_list(order)])
