"""Outcome of ordered stages per object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions._cols import as_list, order_value

SUCCEEDED, FAILED, WAITING = "SUCCEEDED", "FAILED", "WAITING"

# Seconds until the next attempt.
ERROR_RETRY_S = 15
JOB_RUNNING_RETRY_S = 15
JOB_CREATED_RETRY_S = 30
JOB_SUCCEEDED_RETRY_S = 30


def stage_rollup(
    outcomes: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str] = "ord",
    stage: str = "stage",
    ok: str = "ok",
    wait: str | None = None,
    reason: str | None = None,
    retry_after_s: str | None = None,
    at: str | None = None,
) -> DataFrame:
    """One row per object: outcome, stopped_stage, reason, retry_after_s, stages.

    The first stage in order that failed or asks to wait stops the object and later stages
    count as not run. A failed stage retries after ERROR_RETRY_S unless it carries its own
    delay; a waiting stage has only its own, possibly none. With ``at``, next_attempt_at is
    that stage's time plus the delay. ``order`` must be unique within an object.

    Aggregates before the shuffle.
    """
    keys = as_list(keys)
    failed = ~F.coalesce(F.col(ok), F.lit(False))
    waits = F.lit(False) if wait is None else F.coalesce(F.col(wait), F.lit(False))
    own_delay = F.lit(None).cast("int") if retry_after_s is None else F.col(retry_after_s).cast("int")
    delay = F.when(failed, F.coalesce(own_delay, F.lit(ERROR_RETRY_S))).otherwise(own_delay)
    stop = F.struct(
        F.when(failed, F.lit(FAILED)).otherwise(F.lit(WAITING)).alias("outcome"),
        F.col(stage).alias("stopped_stage"),
        (F.lit(None).cast("string") if reason is None else F.col(reason)).alias("reason"),
        delay.alias("retry_after_s"),
        *([] if at is None else [F.col(at).alias("at")]),
    )
    first_stop = F.min_by(stop, F.when(failed | waits, order_value(order)))
    rolled = outcomes.groupBy(*keys).agg(first_stop.alias("_stop"), F.count("*").alias("stages"))
    out = [
        *keys,
        F.coalesce(F.col("_stop.outcome"), F.lit(SUCCEEDED)).alias("outcome"),
        F.col("_stop.stopped_stage"),
        F.col("_stop.reason"),
        F.col("_stop.retry_after_s"),
        "stages",
    ]
    if at is not None:
        due = F.col("_stop.at") + F.make_dt_interval(secs=F.col("_stop.retry_after_s"))
        out.append(due.alias("next_attempt_at"))
    return rolled.select(*out)
