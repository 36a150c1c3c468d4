"""Hard negatives against every pair compared, and the query against its SQL."""

import math
import random

import numpy as np
import pytest
from oracle import database, differences
from pyspark.sql import functions as F

from evenkeel.llm import hard_negatives as hn, queries

SF = "/root/testdata/sf0.001"


def brute_force(rows, is_anchor, n_positives=5, n_negatives=3):
    good = [
        (i, lab, [math.floor(256 * x) for x in v])
        for i, lab, v in rows
        if None not in (i, lab) and v is not None and None not in v and all(map(math.isfinite, v))
    ]
    good = [r for r in good if sum(x * x for x in r[2]) < 2**62]
    out = set()
    for a in {i for i, _, _ in good if is_anchor(i)}:
        _, label, x = min((r for r in good if r[0] == a), key=lambda r: (r[1], r[2]))
        scored = sorted((-sum(p * q for p, q in zip(x, v)), i, lab) for i, lab, v in good if i != a and len(v) == len(x))
        for minus, positive, _ in [s for s in scored if s[2] == label][:n_positives]:
            p = -minus
            inside = [(i, -m) for m, i, lab in scored if lab != label and 50 * p <= -100 * m <= 95 * p]
            out |= {(a, positive, rank, i, p, s) for rank, (i, s) in enumerate(inside[:n_negatives], 1)}
    return out


def mined(spark, rows, every, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    df = df.withColumn("id", F.lit("x")).withColumn("low", F.lit(1)).withColumn("vector", F.lit(2.0))
    found = hn.hard_negatives(df, F.col("id") % every == 0, F.col("label"), **sizes).collect()
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r[c] for c in columns) for r in found]
    assert len(got) == len(set(got))
    return set(got)


def test_query_agrees_with_its_sql(spark):
    assert differences(queries.op12_hard_negatives(spark, SF), database(SF), queries.SQL["op12_hard_negatives"]) == []


@pytest.mark.parametrize("sizes", [{}, {"anchor_block": 3, "row_block": 40}])
def test_ties_copies_and_odd_rows(spark, sizes):
    rng = random.Random(3)
    rows = [(i, i % 4, [rng.randint(-4, 4) / 4 for _ in range(3)]) for i in range(300)]
    rows += [(1000 + i, i % 2, [0.5, 0.25, 0.75]) for i in range(120)]  # a third of the rows are copies
    rows += [(2000, 1, None), (2010, None, [1.0, 1.0, 1.0]), (2020, 1, [1.0, None, 1.0]), (2030, 1, [math.nan, 1.0, 1.0]), (2040, 2, [math.inf, 1.0, 1.0])]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (2050, 1, [0.0, 0.0, 0.0]), (2060, 1, []), (2061, 1, []), (2062, 2, []), (2070, 1, [1.0, 2.0]), (2080, 3, [1.0, 2.0])]
    rows += [(2090, 1, [1e300, 1.0, 1.0]), (2091, 1, [2.0**30, 1.0, 1.0])]
    assert mined(spark, rows, 10, **sizes) == brute_force(rows, lambda i: i % 10 == 0)


def test_many_dimensions_and_large_numbers(spark):
    rng = np.random.default_rng(5)
    spread = np.geomspace(1, 1e-3, 80)  # a few dimensions weigh most, so the bounds leave others out
    rows = [(i, int(i % 3), [float(x) for x in rng.normal(size=80) * spread]) for i in range(400)]
    assert mined(spark, rows, 20) == brute_force(rows, lambda i: i % 20 == 0)
    large = [(i, int(i % 3), [float(x) for x in rng.normal(size=20) * 2.0**18]) for i in range(200)]  # sums beyond 2^53
    assert mined(spark, large, 10) == brute_force(large, lambda i: i % 10 == 0)


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(6)
    rows = np.floor(rng.normal(size=(500, 70)) * np.geomspace(300, 1, 70))
    anchors = np.floor(rng.normal(size=(9, 70)) * np.geomspace(300, 1, 70))
    scores = anchors.astype(int) @ rows.astype(int).T
    postings = hn.Postings(np.arange(500), np.zeros(500, int), rows)
    for threshold in np.quantile(scores, [0.0, 0.5, 0.9, 0.999, 1.0]):
        at, row, score = postings.pairs(anchors, np.full(9, threshold), np.ones((9, 500), bool))
        assert {(a, r, s) for a, r, s in zip(at, row, score)} == {(a, r, scores[a, r]) for a, r in zip(*np.nonzero(scores >= threshold))}


def test_empty_tables(spark):
    assert mined(spark, [], 10) == set()
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])], 10) == set()  # no anchor
    assert mined(spark, [(10, 1, [1.0])], 10) == set()  # no other row
