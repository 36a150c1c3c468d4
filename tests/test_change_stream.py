"""Changes to plan and status: pruned by namespace, the same when a micro-batch runs again."""

import re

import pytest
from pyspark.sql import functions as F
from test_streaming import Feed

from evenkeel.operators import reference_lists
from evenkeel.sources import RowVersions, batch_folder
from evenkeel.streaming import change_stream, edge_table, to_the_end
from evenkeel.streaming.changes import affected_objects, in_batch

CHANGES = "namespace string, kind string, name string, op string"
KEYS = ["namespace", "name"]
REFS = {"secret": ["r1", "r2"]}


class World:
    def __init__(self, spark):
        self.spark, self.feed = spark, Feed(spark, CHANGES)
        self.objects = [("n", "a", "s", "t", 1), ("n", "b", "x", None, 2), ("m", "c", "s", "s", 3), ("m", "d", "", None, 4)]
        place = self.feed.place
        self.edges = edge_table(spark, f"{place}/edges", self.now(None), KEYS)
        self.edges.write(reference_lists(self.now(None), KEYS, REFS, "namespace"), -1)
        self.actual = RowVersions(spark, f"{place}/actual", [*KEYS, "part"], "namespace string, name string, part string, v int", "namespace")
        self.actual.write(spark.createDataFrame([("n", "a", "p", 0), ("m", "c", "p", 3), ("m", "c", "q", 3)], self.actual.schema), -1)
        self.conditions = []

    def now(self, where):
        self.conditions = [*getattr(self, "conditions", []), where]
        df = self.spark.createDataFrame(self.objects, "namespace string, name string, r1 string, r2 string, v int")
        return df if where is None else df.filter(where)

    def desired(self, where):
        parts = F.explode(F.array(F.lit("p"), F.lit("q"))).alias("part")
        return self.now(where).select(*KEYS, parts, "v")

    def play(self, sink=None):
        feed = self.feed
        log = batch_folder(f"{feed.place}/status")
        to_the_end(
            change_stream(
                feed.stream(), self.edges, self.desired, self.actual, sink or log, f"{feed.place}/progress", objects=self.now, object_kind="object", refs=REFS, available_now=True
            )
        )
        rows = self.spark.read.parquet(f"{feed.place}/status").collect()
        return sorted((r.batch_id, r.namespace, r.name, r.created, r.updated, r.unchanged, r.status) for r in rows)


def test_changes_become_plan_and_status(spark):
    w = World(spark)
    w.feed.add([("n", "secret", "s", "update"), ("n", "secret", "s", "update"), ("n", "secret", "nobody", "create")])
    w.feed.add([("m", "secret", "s", "update"), ("n", "secret", "t", "update"), ("m", "object", "d", "create")])
    assert w.play() == [
        (0, "n", "a", 1, 1, 0, "CHANGED"), (1, "m", "c", 0, 0, 2, "IN_SYNC"), (1, "m", "d", 2, 0, 0, "CHANGED"), (1, "n", "a", 0, 0, 2, "IN_SYNC"),
    ]
    # References follow their objects: d now uses s, and a is no longer there.
    w.objects = [("n", "b", "x", None, 2), ("m", "c", "s", "s", 5), ("m", "d", "s", None, 4)]
    w.feed.add([("m", "object", "d", "update"), ("n", "object", "a", "delete")])
    w.feed.add([("m", "secret", "s", "update"), ("n", "secret", "s", "update")])
    assert w.play()[4:] == [
        (2, "m", "d", 0, 0, 2, "IN_SYNC"), (2, "n", "a", 0, 0, 0, "MISSING"), (3, "m", "c", 0, 2, 0, "CHANGED"), (3, "m", "d", 0, 0, 2, "IN_SYNC"),
    ]
    assert {(r.name, r.part, r.v) for r in w.actual.read().collect()} == {(n, p, v) for n, v in (("a", 1), ("c", 5), ("d", 4)) for p in "pq"}


def test_a_batch_that_runs_again_adds_nothing(spark):
    """The log's writer fails once, after the plan was applied."""
    w = World(spark)
    w.feed.add([("n", "secret", "s", "update")])
    w.feed.add([("m", "secret", "s", "update"), ("m", "object", "d", "create")])
    log, failed = batch_folder(f"{w.feed.place}/status"), []

    def once(rows, batch_id):
        log(rows, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost")

    with pytest.raises(Exception):
        w.play(once)
    again = w.play(once)
    assert failed and again == [(0, "n", "a", 1, 1, 0, "CHANGED"), (1, "m", "c", 0, 0, 2, "IN_SYNC"), (1, "m", "d", 2, 0, 0, "CHANGED")]
    assert w.actual.read().count() == 6


def test_a_batch_reads_its_own_namespaces(spark):
    w = World(spark)
    batch = spark.createDataFrame([("n", "secret", "s", "update"), (None, "secret", "s", "update")], CHANGES)
    where = in_batch(batch, "namespace")
    found = affected_objects(batch, w.edges, "namespace", 0, where)
    assert [tuple(r) for r in found.collect()] == [("n", "a")]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*namespace#\d+ (=|IN) \(?n\)?", text)
    assert in_batch(batch, "namespace", 1) is None  # too many to name: all partitions are read
    w.feed.add([("m", "secret", "s", "update")])
    w.conditions.clear()
    w.play()
    assert w.conditions and all(c is not None for c in w.conditions)
