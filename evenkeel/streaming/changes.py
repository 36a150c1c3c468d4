"""From change records to plan and status, as one stream.

What a change affects is looked up in a table of references that is kept by object and partitioned
by namespace; a micro-batch reads the namespaces of its own changes and no others. Its plan is made
from the tables as they were before it, the changed rows are written as its version, and one status
row per object goes to a log by micro-batch. So a micro-batch that runs again adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evenkeel.functions._cols import ColumnLike, as_list
from evenkeel.operators.reconcile import CREATE, NOOP, UPDATE, Policy, reconcile_plan
from evenkeel.operators.references import REFERENCE, reference_lists
from evenkeel.session import stored
from evenkeel.sources.versions import GONE, RowVersions
from evenkeel.streaming.writing import Sink, start

NAMED_NAMESPACES = 500  # a micro-batch with more is not pruned: it reads all partitions
MISSING, CHANGED, IN_SYNC = "MISSING", "CHANGED", "IN_SYNC"


def edge_table(spark: SparkSession, path: str, objects: DataFrame, keys: str | Sequence[str], namespace: str = "namespace") -> RowVersions:
    """The table of references of ``objects`` by key, partitioned by namespace; let it
    ``begin`` with ``reference_lists`` as version -1."""
    columns = dict.fromkeys([*as_list(keys), namespace])
    fields = [T.StructField(c, objects.schema[c].dataType) for c in columns]
    refs = T.StructType.fromDDL(f"refs array<{REFERENCE}>")["refs"]
    return RowVersions(spark, path, list(columns), T.StructType([*fields, refs]), namespace)


def in_batch(batch: DataFrame, namespace: str, limit: int = NAMED_NAMESPACES) -> Column | None:
    """A condition for the partitions that the micro-batch's namespaces are in; none where it has
    more than ``limit`` of them."""
    found = [r[0] for r in batch.select(namespace).distinct().limit(limit + 1).collect()]
    return F.col(namespace).isin([n for n in found if n is not None]) if len(found) <= limit else None


def affected_objects(batch: DataFrame, edges: RowVersions, namespace: str, before: int, where: Column | None) -> DataFrame:
    """Keys of the objects whose references the changes (namespace, kind, name) are among."""
    lists = edges.read(before, where)
    each = lists.select(*edges.keys, F.inline("refs"))
    changed = batch.select(namespace, F.col("kind").alias("ref_kind"), F.col("name").cast("string").alias("ref_name"))
    return each.join(changed, [namespace, "ref_kind", "ref_name"], "left_semi").select(*edges.keys).distinct()


def change_stream(
    changes: DataFrame,
    edges: RowVersions,
    desired: Callable[[Column | None], DataFrame],
    actual: RowVersions,
    sink: Sink,
    checkpoint: str,
    namespace: str = "namespace",
    policy: Policy | Mapping[str, Policy] | None = None,
    values: Sequence[str] | None = None,
    kind: str = "kind",
    objects: Callable[[Column | None], DataFrame] | None = None,
    object_kind: str | None = None,
    object_name: str = "name",
    refs: Mapping[str, Sequence[ColumnLike]] | None = None,
    **trigger,
) -> StreamingQuery:
    """Changes (namespace, kind, name, op), filtered before (``filter_changes``), to plan and status.

    An object is looked at if a change is among its references (``edges``, see ``edge_table``), or
    if it is the changed thing itself (``object_kind``, named by the column ``object_name`` of
    ``objects``); then its references are written anew from ``objects`` and ``refs``, or removed
    where it is no longer there. ``desired`` and ``objects`` are functions of a condition on
    ``namespace`` (or None), called anew for each micro-batch. The rows of ``desired``, any number per object,
    are planned against ``actual``, whose keys begin with those of the objects. What the plan
    changes is written to ``actual`` as the micro-batch's version.

    ``sink`` gets a row per object: its keys, created, updated, unchanged, and status, which is
    MISSING for an object that has no desired rows, CHANGED or IN_SYNC. Give it ``batch_folder`` to
    keep the log by micro-batch.
    """
    spark, owner = changes.sparkSession, edges.keys

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        where = in_batch(batch, namespace)
        asked = affected_objects(batch, edges, namespace, batch_id, where)
        if object_kind is not None:
            own = batch.filter(F.col("kind") == object_kind).select(namespace, F.col("name").alias(object_name)).distinct()
            there = reference_lists(objects(where).join(own, [namespace, object_name], "left_semi"), owner, refs, namespace)
            known = edges.read(batch_id, where).join(own, [namespace, object_name], "left_semi") if object_name in owner else None
            written = there.withColumn(GONE, F.lit(False))
            if known is not None:
                written = written.unionByName(known.join(there.select(*owner), owner, "left_anti").withColumn(GONE, F.lit(True)))
            written = stored(spark, written, "references")
            edges.write(written, batch_id)
            asked = asked.unionByName(written.select(*owner)).distinct()
        asked = stored(spark, asked, "asked")
        want = desired(where).join(asked, owner, "left_semi")
        have = actual.read(batch_id, where, asked, owner)
        plan = stored(spark, reconcile_plan(want, have, actual.keys, policy, values, kind), "plan")
        actual.write(plan.filter(F.col("action") != NOOP), batch_id)
        counts = plan.groupBy(*owner).agg(*(F.count_if(F.col("action") == a).alias(n) for a, n in ((CREATE, "created"), (UPDATE, "updated"), (NOOP, "unchanged"))))
        status = F.when(F.col("created").isNull(), MISSING).when(F.col("created") + F.col("updated") > 0, CHANGED).otherwise(IN_SYNC)
        rows = asked.join(counts, owner, "left").withColumn("status", status)
        try:
            sink(rows.fillna(0, ["created", "updated", "unchanged"]), batch_id)
        finally:
            batch.unpersist()

    return start(changes, each, checkpoint, **trigger)
