"""Nearest neighbours against every pair computed, and the query against its SQL."""

import math
import random

import numpy as np
import pytest
from oracle import database, differences
from pyspark.sql import functions as F

from evenkeel.llm import neighbours, queries

SF = "/root/testdata/sf0.001"


def brute_force(rows, is_query, k):
    good = [(i, v) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = set()
    for q, x in good:
        if is_query(q):
            near = sorted(
                (math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), i) for i, y in good if i != q and len(x) == len(y)
            )
            out |= {(q, rank, i, d) for rank, (d, i) in enumerate(near[:k], 1)}
    return out


def test_query_agrees_with_its_sql(spark):
    assert differences(queries.op9_neighbours(spark, SF), database(SF), queries.SQL["op9_neighbours"]) == []


@pytest.mark.parametrize("query_block, candidate_block", [(4096, 1 << 19), (3, 40)])
def test_ties_duplicates_and_odd_vectors(spark, query_block, candidate_block):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.0, 1.0]) for i in range(60)] + [(2000 + i, [1e-30 * i, 1e20, 0.5]) for i in range(5)]
    rows += [(3000, None), (3001, []), (3002, [0.0, 0.0, 0.0]), (3003, [1.0, None, 2.0]), (3004, [math.nan, 1.0, 1.0])]
    rows += [(3005, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (3010, [1.0, 2.0]), (3020, [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("id") % 10 == 0, 7, query_block=query_block, candidate_block=candidate_block)
    assert {tuple(r) for r in got.collect()} == brute_force(rows, lambda i: i % 10 == 0, 7)


def test_components_whose_squares_overflow_or_vanish(spark):
    rng = random.Random(9)
    sizes = [1e160, 1e308, 1e-310, 1e-200, 5e-324, 1.0]
    rows = [(i, [rng.choice([-1, 1, 0.5]) * rng.choice(sizes) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [rng.random() * 1e160 for _ in range(4)]) for i in range(30)] + [(300 + i, [rng.random() * 1e-310 for _ in range(4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in neighbours.nearest(df, F.col("id") % 10 == 0).collect()}

    def apart(x, y):  # as doubles: a square beyond them is infinite
        return math.sqrt(sum(float(np.square(np.float64(a) - np.float64(b))) for a, b in zip(x, y)))

    want = set()
    with np.errstate(over="ignore"):
        for q, x in rows:
            if q % 10 == 0:
                near = sorted((apart(x, y), i) for i, y in rows if i != q)
                want |= {(q, rank, i, d) for rank, (d, i) in enumerate(near[:10], 1)}
    assert got == want and len(got) == 10 * sum(q % 10 == 0 for q, _ in rows)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 16)) * rng.uniform(0.01, 100, (200, 1))
    integers, scale, rest = neighbours.quantised(x)
    assert np.allclose(np.linalg.norm(x - scale[:, None] * integers, axis=1), rest)
    assert (rest <= scale * 0.5 * 4 + 1e-12).all()


def test_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 5.0), (1, [1.0, 2.5], 5.0)], "vec_id long, embedding array<float>, score double")
    assert [tuple(r) for r in neighbours.nearest(df, F.col("id") == 0).collect()] == [(0, 1, 1, 0.5)]
    assert neighbours.nearest(df.limit(0), F.col("id") == 0).count() == 0
    assert neighbours.nearest(df, F.col("id") == 77).count() == 0
