"""Progress of work that is done by jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions._cols import ColumnLike, as_col, as_list
from evenkeel.functions.arrays import append_list, array_dedup, array_minus
from evenkeel.functions.names import blank_to_null
from evenkeel.operators.skew import null_spread
from evenkeel.operators.stages import (
    JOB_CREATED_RETRY_S,
    JOB_RUNNING_RETRY_S,
    JOB_SUCCEEDED_RETRY_S,
)

DONE, START, CLEAR, WAIT, FAILED = "DONE", "START", "CLEAR", "WAIT", "FAILED"


def installed_items(
    job_events: DataFrame,
    keys: str | Sequence[str],
    items: ColumnLike,
    order: str | Sequence[str] = ("ts", "seq"),
    succeeded: Column | None = None,
) -> DataFrame:
    """The list of each object as rows: (keys, order, item_no, item).

    The installed list is the concatenation of the succeeded jobs' lists in completion order,
    so sorting an object's rows by (order, item_no) reads it off. As rows it needs no shuffle
    and no bound on an object's history.
    """
    rows = job_events if succeeded is None else job_events.filter(succeeded)
    return rows.select(*as_list(keys), *as_list(order), F.posexplode(as_col(items)).alias("item_no", "item"))


def job_state(
    objects: DataFrame,
    jobs: DataFrame,
    keys: str | Sequence[str],
    desired: ColumnLike = "desired",
    installed: ColumnLike = "installed",
    job_name: ColumnLike = "job_name",
    job_items: ColumnLike = "job_items",
    namespace: str | None = "namespace",
    jobs_name: str = "name",
    job_namespace: ColumnLike | None = None,
) -> DataFrame:
    """Next step per object: (keys, action, items, installed, retry_after_s, proceed).

    In this order: a recorded job that succeeded is cleared and its items are appended to the
    installed list; an active one is waited for; a failed one blocks later stages without a
    retry. With no recorded job, or one that cannot be found or has not begun, the missing
    items are started, or nothing is left to do and the next stage may run (``proceed``).

    ``jobs`` has one row per (namespace, name) with counters active, succeeded, failed. The
    recorded job is looked up in ``job_namespace``, the namespace that was recorded with it, and
    in the object's own where that is not given or null.
    """
    keys = as_list(keys)
    on_ns = ["_job_namespace"] if namespace else []
    own = F.col(namespace) if namespace else None
    at = own if job_namespace is None else F.coalesce(blank_to_null(as_col(job_namespace)), own) if namespace else None
    state = objects.select(
        *keys,
        *([at.alias("_job_namespace")] if namespace else []),
        array_dedup(desired).alias("_desired"),
        append_list(installed, F.array()).alias("_installed"),
        blank_to_null(as_col(job_name).cast("string")).alias("_job"),
        as_col(job_items).alias("_items"),
    ).withColumn("_spread", null_spread([F.col("_job")], [F.col(k) for k in keys]))
    counters = jobs.select(
        *([F.col(namespace).alias("_job_namespace")] if namespace else []), F.col(jobs_name).cast("string").alias("_job"), F.lit(0).alias("_spread"), "active", "succeeded", "failed"
    )
    seen = state.join(counters, [*on_ns, "_job", "_spread"], "left")
    todo = array_minus("_desired", "_installed")
    action = (
        F.when(F.col("succeeded") > 0, F.lit(CLEAR))
        .when(F.col("active") > 0, F.lit(WAIT))
        .when(F.col("failed") > 0, F.lit(FAILED))
        .when(F.size(todo) > 0, F.lit(START))
        .otherwise(F.lit(DONE))
    )
    nothing = F.array().cast("array<string>")
    return seen.withColumn("action", action).select(
        *keys,
        "action",
        F.when(F.col("action") == START, todo)
        .when(F.col("action") == CLEAR, F.col("_items"))
        .otherwise(nothing)
        .alias("items"),
        F.when(F.col("action") == CLEAR, append_list("_installed", "_items"))
        .otherwise(F.col("_installed"))
        .alias("installed"),
        F.when(F.col("action") == START, F.lit(JOB_CREATED_RETRY_S))
        .when(F.col("action") == CLEAR, F.lit(JOB_SUCCEEDED_RETRY_S))
        .when(F.col("action") == WAIT, F.lit(JOB_RUNNING_RETRY_S))
        .alias("retry_after_s"),
        (F.col("action") == DONE).alias("proceed"),
    )
