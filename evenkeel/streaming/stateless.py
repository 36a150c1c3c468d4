"""Streams that need no state: each trigger looks at the latest snapshots.

The snapshots are given as functions, called anew for every micro-batch, so a change record
only says which keys to look at and is never trusted as state.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evenkeel.functions._cols import ColumnLike, as_list
from evenkeel.operators.reconcile import NOOP, Policy, apply_plan, reconcile_plan
from evenkeel.operators.references import affected_by
from evenkeel.operators.rows import distinct_requests
from evenkeel.sources.versions import RowVersions
from evenkeel.streaming.writing import Sink, start

Snapshot = Callable[[], DataFrame]


def affected_stream(
    changes: DataFrame,
    objects: Snapshot,
    keys: str | Sequence[str],
    refs: Mapping[str, Sequence[ColumnLike]],
    sink: Sink,
    checkpoint: str,
    namespace: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Keys of the objects that each micro-batch of changes (kind, name) affects.

    Filter the changes first (``filter_changes`` works on streams).
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(affected_by(objects(), batch, keys, refs, namespace), batch_id)

    return start(changes, each, checkpoint, **trigger)


def reconcile_stream(
    requests: DataFrame,
    desired: Snapshot,
    actual: Snapshot | RowVersions,
    keys: str | Sequence[str],
    sink: Sink,
    checkpoint: str,
    policy: Policy | None = None,
    values: Sequence[str] | None = None,
    applied: Sink | None = None,
    **trigger,
) -> StreamingQuery:
    """Plan again for the keys of each micro-batch of requests, from the latest snapshots.

    ``sink`` gets the plan. Where ``actual`` is a table of row versions, the changed rows, and
    nothing else, are written to it as the version of the micro-batch, which reads what was there
    before it. Else ``applied``, if given, gets the whole actual table after the plan.
    """
    on = as_list(keys)

    def each(batch: DataFrame, batch_id: int) -> None:
        # Both are read more than once; the batch must not be fetched again for it.
        touched = distinct_requests(batch, on).persist()
        want = desired().join(touched, on, "left_semi")
        kept = isinstance(actual, RowVersions)
        have = actual.read(batch_id, touched=touched) if kept else actual()
        plan = reconcile_plan(want, have if kept else have.join(touched, on, "left_semi"), on, policy, values)
        if kept or applied is not None:
            plan.persist()
        try:
            sink(plan, batch_id)
            if kept:
                actual.write(plan.filter(F.col("action") != NOOP), batch_id)
            elif applied is not None:
                applied(apply_plan(have, plan, on), batch_id)
        finally:
            plan.unpersist()
            touched.unpersist()

    return start(requests, each, checkpoint, **trigger)
