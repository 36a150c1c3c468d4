"""Random rows against plain Python, many cases in one table."""

import random

from pyspark.sql import functions as F

from evenkeel import functions as K
from evenkeel import operators as O


def lists(rng, n):
    pool = ["a", "b", "c", "d", None]
    pick = lambda: None if rng.random() < 0.1 else [rng.choice(pool) for _ in range(rng.randrange(6))]
    return [(i, pick(), pick()) for i in range(n)]


def test_list_functions(spark):
    rows = lists(random.Random(7), 600)
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    out = df.select(
        "i",
        K.array_minus("a", "b").alias("minus"),
        K.has_missing("a", "b").alias("missing"),
        K.array_dedup("a").alias("dedup"),
        K.append_list("a", "b").alias("both"),
    )
    got = {r.i: r for r in out.collect()}
    for i, a, b in rows:
        left, right = a or [], b or []
        minus = [x for x in left if x not in right]
        assert got[i].minus == minus
        assert got[i].missing == bool(minus)
        assert got[i].dedup == (None if a is None else list(dict.fromkeys(a)))
        assert got[i].both == left + right


def test_array_minus_of_long_lists(spark):
    """Duplicates, nulls and 20,000 items on each side; halving, not one look at each pair."""
    rng = random.Random(11)
    pick = lambda n: [None if rng.random() < 0.01 else rng.randrange(30_000) for _ in range(n)]
    rows = [(0, pick(20_000), pick(20_000)), (1, pick(300), []), (2, pick(300), [None]), (3, pick(300), [5]), (4, [7, 7], pick(1_000))]
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<bigint>")
    got = {r.i: r.minus for r in df.select("i", K.array_minus("a", "b").alias("minus")).collect()}
    for i, a, b in rows:
        drop = set(b)
        assert got[i] == [x for x in a if x not in drop]


def test_rows_minus_is_array_minus_on_rows(spark):
    rows = lists(random.Random(8), 200)
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    a = df.select("i", F.posexplode("a").alias("at", "x")).filter("x is not null")
    b = df.select("i", F.explode("b").alias("x"))
    got = sorted((r.i, r.at, r.x) for r in O.rows_minus(a, b, ["i", "x"]).collect())
    assert got == sorted(
        (i, n, x) for i, p, q in rows for n, x in enumerate(p or []) if x is not None and x not in (q or [])
    )


def test_apply_plan_reaches_the_desired_state(spark):
    rng = random.Random(9)
    side = lambda: [(k, rng.choice([1, 2, None]), rng.choice(["x", "y", None])) for k in range(400) if rng.random() < 0.7]
    want, have = side(), side()
    ddl = "k int, n int, v string"
    desired, actual = spark.createDataFrame(want, ddl), spark.createDataFrame(have, ddl)
    plan = O.reconcile_plan(desired, actual, "k")
    old = {r[0]: r for r in have}
    for r in plan.collect():
        row = (r.k, r.n, r.v)
        changed = [] if r.k not in old else [c for c, p, q in zip(("n", "v"), row[1:], old[r.k][1:]) if p != q]
        assert r.changed_cols == changed
        assert r.action == ("CREATE" if r.k not in old else "UPDATE" if changed else "NOOP")
    after = {r[0]: tuple(r) for r in O.apply_plan(actual, plan, "k").collect()}
    assert after == {**old, **{r[0]: r for r in want}}
