"""Job steps with a bounded state against plain Python, with replays, late rows and long histories."""

import random
from datetime import datetime, timedelta

import pytest
from test_streaming import OBSERVED, Feed

from evenkeel.sources import RowVersions
from evenkeel.streaming import job_steps

T0 = datetime(2024, 1, 1)


def at(n):
    return T0 + timedelta(seconds=n)


def steps_of(feed, out="steps", state="state", keys="object"):
    return feed.run(lambda sink, place: job_steps(feed.stream(), sink, place, f"{feed.place}/{state}", keys, available_now=True), out)


def plain(rows):
    """The walk, row by row, without runs, tables or micro-batches."""
    jobs, installed, out = {}, {}, []
    for key, _, seq, wanted, active, succeeded, failed in sorted(rows, key=lambda r: (r[1], r[2])):
        job, have = jobs.get(key), installed.setdefault(key, [])
        missing = [x for x in dict.fromkeys(wanted or ()) if x not in have]
        if job is not None and (succeeded or 0) > 0:
            step = ("CLEAR", job, 30)
            installed[key], jobs[key] = have + job, None
        elif job is not None and (active or 0) > 0:
            step = ("WAIT", [], 15)
        elif job is not None and (failed or 0) > 0:
            step = ("FAILED", [], None)
        elif missing:
            step = ("START", missing, 30)
            jobs[key] = missing
        else:
            step = ("DONE", [], None)
        out.append((seq, *step))
    return sorted(out), jobs, installed


def random_rows(rng, n):
    rows, last = [], {}
    for seq in range(n):
        key = rng.choice(["o", "p", None])
        if rng.random() < 0.5 or key not in last:  # else as before, so that there are runs
            counters = rng.choice([(None,) * 3, (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (1, 1, 1)])
            last[key] = (rng.choice([None, [], rng.choices(["a", "b", "c", "d", None], k=3)]), *counters)
        rows.append((key, at(seq // 2), seq, *last[key]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 240)
    feed = Feed(spark, OBSERVED)
    for i in range(0, 240, 80):
        part = rows[i : i + 80]
        rng.shuffle(part)
        feed.add(part)
    found = steps_of(feed).collect()
    want, jobs, installed = plain(rows)
    assert sorted((r.seq, r.action, r["items"], r.retry_after_s) for r in found) == want
    assert all(r.next_attempt_at == (None if r.retry_after_s is None else r.ts + timedelta(seconds=r.retry_after_s)) for r in found)
    kept = RowVersions(spark, f"{feed.place}/state/installed", ["object", "_item"], "object string, _item string, ts timestamp_ntz, seq bigint")
    have = [(r.object, r._item) for r in kept.history().collect()]
    assert sorted(have, key=repr) == sorted(((k, x) for k, xs in installed.items() for x in xs), key=repr)


def test_state_does_not_grow_with_what_was_installed(spark):
    """10,000 jobs of one key, each with an item of its own: its state stays one short row."""
    feed = Feed(spark, OBSERVED)
    sizes = []
    rows = [("o", at(n), n, [f"item{n // 2}"], None, n % 2, None) for n in range(20_000)]
    for i in range(2):
        feed.add(rows[i * 10_000 : (i + 1) * 10_000])
        out = steps_of(feed)
        jobs = spark.read.parquet(f"{feed.place}/state/jobs/rows/_version={i}").collect()
        sizes.append([(r.object, r.seq, r._job) for r in jobs])
    assert sizes == [[("o", 9_999, None)], [("o", 19_999, None)]]
    assert {r.action: r["count"] for r in out.groupBy("action").count().collect()} == {"START": 10_000, "CLEAR": 10_000}
    feed.add([("o", at(30_000), 30_000, ["item0", "item9999", "new"], None, None, None)])
    last = steps_of(feed).filter("seq = 30000").collect()
    assert [(r.action, r["items"]) for r in last] == [("START", ["new"])]


def test_long_runs_repeat_their_step(spark):
    feed = Feed(spark, OBSERVED)
    rows = [("o", at(n), n, ["a"], 1, 0, 0) for n in range(50)] + [("o", at(n), n, ["a"], 0, 1, 0) for n in range(50, 100)]
    feed.add(rows)
    out = steps_of(feed).orderBy("seq").collect()
    assert [r.action for r in out] == ["START"] + ["WAIT"] * 49 + ["CLEAR"] + ["DONE"] * 49
    assert [(r.seq, r.action, r["items"], r.retry_after_s) for r in out] == plain(rows)[0]


def test_late_replayed_and_empty(spark):
    feed = Feed(spark, OBSERVED)
    feed.add([("o", at(2), 2, ["a"], None, None, None)])
    feed.add([("o", at(1), 1, ["b"], None, None, None), ("o", at(2), 2, ["a"], None, None, None), ("o", at(3), 3, ["a"], 0, 1, 0)])
    feed.add([])
    feed.add([("o", at(4), 4, ["a"], None, None, None)])
    out = steps_of(feed).orderBy("seq").collect()
    assert [(r.seq, r.action, r["items"]) for r in out] == [(1, "LATE", []), (2, "START", ["a"]), (3, "CLEAR", ["a"]), (4, "DONE", [])]


def test_a_micro_batch_that_runs_twice_gives_the_same(spark):
    """Another progress folder over the same state begins at micro-batch 0 again."""
    rows = random_rows(random.Random(5), 120)
    feed = Feed(spark, OBSERVED)
    feed.add(rows[:60])
    feed.add(rows[60:])
    told = [sorted(map(repr, steps_of(feed, out).collect())) for out in ("once", "again")]
    assert told[0] == told[1]
