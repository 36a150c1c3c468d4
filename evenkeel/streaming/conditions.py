"""Condition tracking on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evenkeel.functions._cols import as_list
from evenkeel.operators.rows import SLICES, last_runs, slice_cuts
from evenkeel.streaming._keyed import keep_state, last_rows, parted, state_table
from evenkeel.streaming.writing import Sink, start


def track_conditions(
    stream: DataFrame,
    sink: Sink,
    checkpoint: str,
    state: str,
    keys: str | Sequence[str] = ("namespace", "object", "type"),
    ts: str = "ts",
    seq: str = "seq",
    status: str = "status",
    values: Sequence[str] = ("reason", "message"),
    slices: int = SLICES,
    **trigger,
) -> StreamingQuery:
    """Per micro-batch the current row of each changed condition: (keys, ts, seq, status, values,
    last_transition_time, late).

    Rows of one key come unordered inside a micro-batch and are put in (ts, seq) order. A row
    before the stored one comes too late to count: it is given as it is, with ``late`` true and no
    transition time, so that nothing is lost unseen; a replay of the stored row gives nothing.

    The last row of each key, with the time of its last transition, is kept in the folder ``state``
    as versions by micro-batch, so a micro-batch that runs again reads what it read before. It is
    one more row of the key's log, and the transitions are those of the log so far.
    """
    keys, values, order = as_list(keys), list(values), [ts, seq]
    kept = state_table(stream, state, keys, [ts, seq, status], [T.StructField("_since", stream.schema[ts].dataType)])
    names = [*keys, ts, seq, status, *values]

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(*names).persist()
        before = last_rows(kept, batch, order, batch_id).persist()
        rows = parted(batch, before, keys, order)
        fresh = rows.filter("_when = 1").withColumn("_moment", F.col(ts))
        log = fresh.unionByName(before.withColumnRenamed("_since", "_moment").withColumn("_when", F.lit(0)), allowMissingColumns=True)
        found = last_runs(log, keys, order, status, "_moment", [ts, seq, status, *values, "_when"], slice_cuts(batch, order, slices))
        now = found.filter("_when = 1").select(*names, F.col("_since").alias("last_transition_time")).persist()
        late = rows.filter("_when = -1").select(*names, F.lit(None).cast(stream.schema[ts].dataType).alias("last_transition_time"))
        try:
            sink(now.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))), batch_id)
            keep_state(kept, now.withColumnRenamed("last_transition_time", "_since"), batch_id)
        finally:
            for df in (now, before, batch):
                df.unpersist()

    return start(stream, each, checkpoint, **trigger)
