"""Streams in several micro-batches against their batch twins and brute force."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evenkeel import functions as K
from evenkeel import shared_dir
from evenkeel import operators as O
from evenkeel.operators.conditions import latest_rows
from evenkeel.session import folders
from evenkeel.sources import RowVersions, append_status, batch_folder, read_changes
from evenkeel.streaming import (
    affected_stream,
    reconcile_stream,
    start,
    suppress_unchanged,
    to_the_end,
    track_conditions,
    track_jobs,
)

T0 = datetime(2024, 1, 1)


class Feed:
    """A folder of one file per slice, read one file per micro-batch."""

    def __init__(self, spark, schema):
        self.spark, self.schema = spark, schema
        self.place = shared_dir(spark, "feed")

    def add(self, rows):
        df = self.spark.createDataFrame(rows, self.schema).coalesce(1)
        append_status(df, f"{self.place}/in")

    def stream(self):
        return read_changes(self.spark, f"{self.place}/in", self.schema, max_files=1)

    def run(self, begin, out="out"):
        to_the_end(begin(batch_folder(f"{self.place}/{out}"), f"{self.place}/progress-{out}"))
        return self.spark.read.parquet(f"{self.place}/{out}")

    def play(self, stream, mode="append"):
        return self.run(lambda sink, at: start(stream, sink, at, mode, available_now=True))


    def conditions(self, keys, **more):
        state = f"{self.place}/state"
        return self.run(lambda sink, at: track_conditions(self.stream(), sink, at, state, keys, values=["reason"], available_now=True, **more))

    def changed(self, content, **more):
        state = f"{self.place}/state"
        return self.run(lambda sink, at: suppress_unchanged(self.stream(), sink, at, state, "object", content, available_now=True, **more))


LOG = "object string, type string, status string, reason string, ts timestamp_ntz, seq bigint"


def condition_slices(seed, slices=3, n=120):
    rng = random.Random(seed)
    out, seq = [], 0
    for s in range(slices):
        rows = []
        for _ in range(n):
            key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}"
            ts = T0 + timedelta(hours=s, seconds=rng.randrange(60))
            rows.append((key, "Ready", rng.choice(["True", "True", "False", None]), f"r{seq}", ts, seq))
            seq += 1
        rng.shuffle(rows)
        out.append(rows)
    return out


def test_track_conditions_agrees_with_the_batch_twins(spark):
    feed = Feed(spark, LOG)
    for rows in condition_slices(5):
        feed.add(rows)
    keys = ["object", "type"]
    out = feed.conditions(keys)
    assert out.select("batch_id").distinct().count() == 3
    got = {tuple(r) for r in latest_rows(out, keys, ["ts", "seq"]).select("object", "status", "reason", "last_transition_time").collect()}
    log = read_changes(spark, f"{feed.place}/in", LOG, stream=False)
    current = O.current_conditions(log, keys, values=["status", "reason"])
    moved = O.condition_transitions(log, keys).select(*keys, "last_transition_time")
    twin = current.join(moved, keys).select("object", "status", "reason", "last_transition_time")
    assert got == {tuple(r) for r in twin.collect()}


def test_late_rows_are_marked_and_replays_dropped(spark):
    feed = Feed(spark, LOG)
    first = ("o", "t", "True", "a", T0 + timedelta(hours=1), 5)
    feed.add([first])
    feed.add([first, ("o", "t", "False", "late", T0, 6)])
    feed.add([("o", "t", "True", "b", T0 + timedelta(hours=1), 6)])
    out = feed.conditions(["object", "type"])
    rows = sorted((r.batch_id, r.reason, r.last_transition_time, r.late) for r in out.collect())
    assert rows == [(0, "a", first[4], False), (1, "late", None, True), (2, "b", first[4], False)]


OBSERVED = "object string, ts timestamp_ntz, seq bigint, desired array<string>, active int, succeeded int, failed int"


def at(n):
    return T0 + timedelta(minutes=n)


def test_track_jobs_scenarios(spark):
    feed = Feed(spark, OBSERVED)
    feed.add([
        ("o", at(1), 1, ["base", "web", "base"], None, None, None),
        ("o", at(2), 2, ["base", "web"], 1, 0, 0),
        ("p", at(1), 3, [], None, None, None),
    ])
    feed.add([
        ("o", at(3), 4, ["base", "web"], 1, 1, 1),
        ("o", at(5), 6, ["base", "web"], None, None, None),
        ("o", at(4), 5, ["base", "web", "crm"], None, None, None),
        ("p", at(2), 7, ["x"], None, None, None),
    ])
    feed.add([("o", at(6), 8, ["crm"], 0, 0, 2), ("o", at(7), 9, ["crm"], 0, 0, 0), ("p", at(3), 10, None, 0, 1, 0)])
    out = feed.play(track_jobs(feed.stream(), "object"))
    rows = [(r.seq, r.action, r["items"], r.installed, r.retry_after_s) for r in out.orderBy("seq").collect()]
    both = ["base", "web"]
    assert rows == [
        (1, "START", both, None, 30),
        (2, "WAIT", [], None, 15),
        (3, "DONE", [], None, None),
        (4, "CLEAR", both, both, 30),
        (5, "START", ["crm"], None, 30),
        (6, "DONE", [], None, None),
        (7, "START", ["x"], None, 30),
        (8, "FAILED", [], None, None),
        (9, "START", ["crm"], None, 30),
        (10, "CLEAR", ["x"], ["x"], 30),
    ]
    due = {r.seq: r.next_attempt_at for r in out.collect()}
    assert due[1] == at(1) + timedelta(seconds=30) and due[2] == at(2) + timedelta(seconds=15) and due[3] is None


def test_one_step_of_track_jobs_is_job_state(spark):
    """Each step from the state before it, as the batch operator sees it."""
    rng = random.Random(3)
    rows = []
    for seq in range(60):
        counters = rng.choice([(None,) * 3, (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)])
        rows.append((f"o{seq % 3}", at(seq), seq, rng.sample(["a", "b", "c", "d"], 2), *counters))
    feed = Feed(spark, OBSERVED)
    feed.add(rows[:30])
    feed.add(rows[30:])
    steps = feed.play(track_jobs(feed.stream(), "object")).orderBy("seq").collect()
    state, objects, jobs = {}, [], []
    for row, step in zip(rows, steps):
        job, installed = state.get(row[0], (None, []))
        name = f"j{row[2]}"
        objects.append((row[2], row[3], installed, name if job is not None else None, job))
        if row[4] is not None:
            jobs.append((name, *row[4:]))
        job = {"START": step["items"], "CLEAR": None}.get(step.action, job)
        state[row[0]] = (job, step.installed if step.action == "CLEAR" else installed)
    twin = O.job_state(
        spark.createDataFrame(objects, "seq bigint, desired array<string>, installed array<string>, job_name string, job_items array<string>"),
        spark.createDataFrame(jobs, "name string, active int, succeeded int, failed int"),
        "seq", namespace=None,
    ).orderBy("seq").collect()
    assert [(r.seq, r.action, r["items"], r.installed if r.action == "CLEAR" else None, r.retry_after_s) for r in twin] == [
        (s.seq, s.action, s["items"], s.installed, s.retry_after_s) for s in steps
    ]


def test_due_row_after_the_delay(spark):
    feed = Feed(spark, OBSERVED)
    feed.add([("o", at(1), 1, ["a"], None, None, None), ("o", at(2), 2, ["a"], 1, 0, 0)])
    seen = []

    def sink(batch, batch_id):
        seen.extend(r.action for r in batch.orderBy("seq").collect())

    began = time.time()
    query = start(
        track_jobs(feed.stream(), "object", emit_due=True), sink, f"{feed.place}/progress", every="1 second"
    )
    try:
        deadline = time.time() + 90
        while seen.count("DUE") < 2 and time.time() < deadline:
            time.sleep(0.5)
        took = time.time() - began
    finally:
        query.stop()
    # One DUE per delay of 15 seconds, not one per trigger.
    assert seen == ["START", "WAIT", "DUE", "DUE"] and took > 28


def test_suppress_unchanged(spark):
    feed = Feed(spark, "object string, ts timestamp_ntz, seq bigint, data map<string,string>, note string")
    feed.add([
        ("o", at(1), 1, {"a": "1", "b": "2"}, "x"), ("o", at(2), 2, {"b": "2", "a": "1"}, "x"),
        ("o", at(3), 3, {"a": "1"}, "x"), ("p", at(1), 4, None, None),
    ])
    feed.add([("o", at(5), 6, {"a": "1"}, None), ("o", at(4), 5, {"a": "1"}, "x"), ("p", at(2), 7, None, None)])
    out = feed.changed(["data", "note"])
    assert sorted(r.seq for r in out.collect()) == [1, 3, 4, 6]


def test_suppress_unchanged_sees_microseconds_and_late_rows(spark):
    feed = Feed(spark, "object string, ts timestamp_ntz, seq bigint, seen timestamp_ntz, raw binary")
    feed.add([("o", at(1), 1, T0, b"x"), ("o", at(2), 2, T0 + timedelta(microseconds=1), b"x")])
    feed.add([("o", at(3), 3, T0 + timedelta(microseconds=1), b"x"), ("o", at(1), 0, T0, b"x"), ("o", at(2), 2, T0, b"x")])
    feed.add([("o", at(4), 4, T0 + timedelta(microseconds=1), b"y")])
    out = feed.changed(["seen", "raw"])
    assert sorted((r.seq, r.late) for r in out.collect()) == [(0, True), (1, False), (2, False), (4, False)]


def test_late_observations_are_marked(spark):
    feed = Feed(spark, OBSERVED)
    feed.add([("o", at(2), 2, ["a"], None, None, None)])
    feed.add([("o", at(1), 1, ["b"], None, None, None), ("o", at(2), 2, ["a"], None, None, None), ("o", at(3), 3, ["a"], 0, 1, 0)])
    out = feed.play(track_jobs(feed.stream(), "object")).orderBy("seq").collect()
    assert [(r.seq, r.action) for r in out] == [(1, "LATE"), (2, "START"), (3, "CLEAR")]


def test_registered_streams_run_in_several_batches(spark):
    from evenkeel.plans.registry import feed as replayed

    counts = []
    stream = replayed(spark, "/root/testdata/sf0.001", "events")
    to_the_end(start(stream, lambda b, n: counts.append(b.count()), shared_dir(spark, "progress"), available_now=True))
    assert len(counts) >= 4 and sum(counts) == 1000 and min(counts) > 0


def test_affected_stream_looks_at_the_latest_objects(spark):
    feed = Feed(spark, "namespace string, kind string, name string")
    feed.add([("n", "secret", "s"), ("n", "secret", "s")])
    feed.add([("n", "secret", "t"), ("m", "secret", "s")])
    objects = spark.createDataFrame(
        [("n", "a", "s", "t"), ("n", "b", "x", None), ("m", "c", "s", "s")], "namespace string, object string, r1 string, r2 string"
    )
    calls = []

    def latest():
        calls.append(1)
        return objects

    out = feed.run(
        lambda sink, p: affected_stream(
            feed.stream(), latest, ["namespace", "object"], {"secret": ["r1", "r2"]}, sink, p, namespace="namespace", available_now=True
        )
    )
    rows = sorted((r.batch_id, r.namespace, r.object) for r in out.collect())
    assert rows == [(0, "n", "a"), (1, "m", "c"), (1, "n", "a")]
    assert len(calls) == 2


def test_reconcile_stream_plans_touched_keys_and_applies(spark):
    feed = Feed(spark, "k int")
    feed.add([(1,), (2,), (1,)])
    feed.add([(3,), (7,)])
    ddl = "k int, v string"
    desired = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], ddl)
    tables = {"now": spark.createDataFrame([(2, "old"), (3, "c"), (9, "extra")], ddl)}
    after = f"{feed.place}/after"

    def applied(table, batch_id):
        table.write.mode("overwrite").parquet(f"{after}-{batch_id}")
        tables["now"] = spark.read.parquet(f"{after}-{batch_id}")

    out = feed.run(
        lambda sink, p: reconcile_stream(
            feed.stream(), lambda: desired, lambda: tables["now"], "k", sink, p, applied=applied, available_now=True
        )
    )
    rows = sorted((r.batch_id, r.k, r.action) for r in out.collect())
    assert rows == [(0, 1, "CREATE"), (0, 2, "UPDATE"), (1, 3, "NOOP")]
    assert sorted(tuple(r) for r in tables["now"].collect()) == [(1, "a"), (2, "b"), (3, "c"), (9, "extra")]


def test_change_filter_works_on_a_stream(spark):
    feed = Feed(spark, "kind string, op string, before map<string,string>, after map<string,string>")
    feed.add([("c", "update", {"a": "1"}, {"a": "1"}), ("c", "update", {"a": "1"}, {"a": "2"}), ("x", "create", None, None)])
    rules = {"c": O.ChangeRules(update=~K.maps_equal("before", "after"))}
    assert feed.play(O.filter_changes(feed.stream(), rules)).count() == 1


def test_a_batch_written_again_adds_nothing(spark):
    place = shared_dir(spark, "again")
    sink = batch_folder(place)
    df = spark.range(5)
    sink(df, 0)
    sink(df, 0)
    assert spark.read.parquet(place).count() == 5


def test_stream_failures_are_raised(spark):
    feed = Feed(spark, "k int")
    feed.add([(1,)])
    with pytest.raises(Exception):
        feed.play(feed.stream().select(F.raise_error(F.lit("boom")).alias("x")))


def test_a_condition_batch_that_runs_again_reads_and_leaves_the_same(spark):
    """The sink fails once after the state was written: the batch runs again, as after a lost driver."""
    feed = Feed(spark, LOG)
    for rows in condition_slices(7):
        feed.add(rows)
    keys, state, wrote = ["object", "type"], f"{feed.place}/state", batch_folder(f"{feed.place}/twice")

    def play(sink):
        to_the_end(track_conditions(feed.stream(), sink, f"{feed.place}/progress", state, keys, values=["reason"], available_now=True))

    failed = []

    def once(batch, batch_id):
        wrote(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            kept = RowVersions(spark, state, keys, "object string, type string, ts timestamp_ntz, seq bigint, status string, _since timestamp_ntz")
            # As if the state had been written before the failure, and differently.
            kept.write(kept.read().withColumn("_since", F.lit(T0)), 1)
            raise RuntimeError("lost")

    with pytest.raises(Exception):
        play(once)
    play(once)
    again = {tuple(r) for r in spark.read.parquet(f"{feed.place}/twice").collect()}
    fresh = Feed(spark, LOG)
    for rows in condition_slices(7):
        fresh.add(rows)
    assert failed and again == {tuple(r) for r in fresh.conditions(keys, slices=3).collect()}


@pytest.mark.parametrize("slices", [1, 5])
def test_null_keys_and_times_are_rows_like_others(spark, slices):
    feed = Feed(spark, LOG)
    feed.add([(None, "t", "True", "a", T0, 1), (None, "t", "True", "b", T0 + timedelta(1), 2), ("o", "t", None, "c", None, 3)])
    feed.add([(None, "t", None, "d", T0 + timedelta(2), 4), ("o", "t", None, "e", T0, 5), ("o", "t", None, "f", T0 + timedelta(3), 6)])
    out = feed.conditions(["object", "type"], slices=slices)
    rows = sorted((r.batch_id, r.reason, r.last_transition_time) for r in out.collect())
    assert rows == [(0, "b", T0), (0, "c", None), (1, "d", T0 + timedelta(2)), (1, "f", None)]


def test_streams_compact_their_state(spark, monkeypatch):
    from evenkeel.streaming import _keyed

    monkeypatch.setattr(_keyed, "COMPACT_EVERY", 2)
    feed = Feed(spark, "object string, ts timestamp_ntz, seq bigint, data string")
    for n in range(6):
        feed.add([(f"k{k}", at(n), 10 * n + k, "x" if n < 3 else "y") for k in range(5)])
    out = feed.changed(["data"])
    assert sorted((r.batch_id, r.seq) for r in out.collect()) == [(0, k) for k in range(5)] + [(3, 30 + k) for k in range(5)]
    assert folders(spark, f"{feed.place}/state/base") == ["_version=3", "_version=5"]
    assert folders(spark, f"{feed.place}/state/rows") == ["_version=4", "_version=5"]
