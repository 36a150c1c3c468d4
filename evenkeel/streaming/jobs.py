"""Job progress on a stream."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from evenkeel.functions._cols import as_list
from evenkeel.operators.jobs import CLEAR, DONE, FAILED, START, WAIT
from evenkeel.operators.stages import (
    JOB_CREATED_RETRY_S,
    JOB_RUNNING_RETRY_S,
    JOB_SUCCEEDED_RETRY_S,
)
from evenkeel.session import ship_package
from evenkeel.streaming._state import fields, micros, parted_chunks

DUE = "DUE"
LATE = "LATE"
STATE = "ts long, seq long, job array<string>, installed array<string>, delay int"


def next_step(job: list | None, have: set, wanted: Sequence | None, succeeded: bool, active: bool, failed: bool):
    """(action, items, delay, recorded job afterwards) of an observation, as in ``job_state``."""
    if job is not None and succeeded:
        return CLEAR, job, JOB_SUCCEEDED_RETRY_S, None
    if job is not None and active:
        return WAIT, [], JOB_RUNNING_RETRY_S, job
    if job is not None and failed:
        return FAILED, [], None, job
    items = [x for x in dict.fromkeys(wanted if wanted is not None else ()) if x not in have]
    return (START, items, JOB_CREATED_RETRY_S, items) if items else (DONE, [], None, job)


def track_jobs(
    stream: DataFrame,
    keys: str | Sequence[str] = ("namespace", "object"),
    ts: str = "ts",
    seq: str = "seq",
    desired: str = "desired",
    emit_due: bool = False,
) -> DataFrame:
    """One row per observation: (keys, ts, seq, action, items, installed, retry_after_s,
    next_attempt_at).

    An observation carries the wanted list and the counters active, succeeded, failed of the
    recorded job (all null when the job is not found). The state is the recorded job's items
    and the installed list, which is given only where it changes (CLEAR); steps are those of
    ``job_state``. With ``emit_due`` a key that is
    not observed again within its delay gives a row DUE, by processing time, and once more after
    each further delay; such a stream needs a recurring trigger, as one over what is available now
    would never end. An observation before the stored one comes too late to count and gives a row
    LATE; a replay of the stored one gives nothing.
    """
    ship_package(stream.sparkSession)
    keys = as_list(keys)
    out = T.StructType(
        [
            *fields(stream, [*keys, ts, seq]),
            T.StructField("action", T.StringType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("installed", T.ArrayType(T.StringType())),
            T.StructField("retry_after_s", T.IntegerType()),
            T.StructField("next_attempt_at", stream.schema[ts].dataType),
        ]
    )
    timeout = GroupStateTimeout.ProcessingTimeTimeout if emit_due else GroupStateTimeout.NoTimeout

    def frame(key, us, no, steps):
        """``steps`` has (action, items, installed, delay) per row."""
        action, items, installed, delay = zip(*steps)
        wait = np.array([-1 if d is None else d for d in delay])
        due = (us + wait * 1_000_000).astype("datetime64[us]")
        due[wait < 0] = np.datetime64("NaT")
        return pd.DataFrame(
            {
                **{k: [v] * len(steps) for k, v in zip(keys, key)},
                ts: us.astype("datetime64[us]"),
                seq: no,
                "action": action,
                "items": items,
                "installed": installed,
                "retry_after_s": pd.array(delay, dtype="Int32"),
                "next_attempt_at": due,
            }
        )

    def step(key, chunks, state):
        if state.hasTimedOut:
            us, no, _, _, delay = state.get
            state.update(state.get)
            state.setTimeoutDuration(delay * 1000)
            yield frame(key, np.array([us]), np.array([no]), [(DUE, [], None, None)])
            return
        last = state.get if state.exists else (None, None, None, [], None)
        seen = None if last[0] is None else (last[0], last[1])
        pdf, late = parted_chunks(chunks, ts, seq, seen)
        if len(late):
            yield frame(key, micros(late[ts]), late[seq].to_numpy(dtype="int64"), [(LATE, [], None, None)] * len(late))
        if pdf.empty:
            if emit_due and last[4] is not None:  # the timer of a key is cleared by being called
                state.update(last)
                state.setTimeoutDuration(last[4] * 1000)
            return
        us, no = micros(pdf[ts]), pdf[seq].to_numpy(dtype="int64")
        order = np.lexsort((no, us))
        job = None if last[2] is None else list(last[2])
        installed = list(last[3] or [])
        have = set(installed)
        steps, delay = [], None
        counts = np.nan_to_num(
            np.column_stack([pdf[c].to_numpy(dtype="float64", na_value=np.nan) for c in ("succeeded", "active", "failed")])
        )
        wanted = pdf[desired].to_numpy(dtype=object)
        for i in order:
            action, items, delay, job = next_step(job, have, wanted[i], *(counts[i] > 0))
            if action == CLEAR:
                installed = installed + items
                have.update(items)
            steps.append((action, items, installed if action == CLEAR else None, delay))
        top = order[-1]
        state.update((int(us[top]), int(no[top]), job, installed, delay))
        if emit_due and delay is not None:
            state.setTimeoutDuration(delay * 1000)
        yield frame(key, us[order], no[order], steps)

    columns = [*keys, ts, seq, desired, "active", "succeeded", "failed"]
    return stream.select(*columns).groupBy(*keys).applyInPandasWithState(
        step, out, STATE, "append", timeout
    )
