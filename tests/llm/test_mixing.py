"""Mixing: copies follow the Poisson distribution, decisions depend on the row alone."""

import math

import pytest
from oracle import database, differences
from pyspark.sql import functions as F

from evenkeel.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def test_query_agrees_with_its_sql(spark):
    assert differences(queries.op5_mixing(spark, SF), database(SF), queries.SQL["op5_mixing"]) == []


@pytest.mark.parametrize("rate", [0.3, 2.0, 40.0, 1500.0])
def test_steps_are_the_distribution(spark, rate):
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(rate)).alias("s")).first().s
    p, total = [], 0.0
    for k in range(len(steps)):
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        p.append(total)
    assert max(abs(a - b) for a, b in zip(steps, p)) < 1e-9
    assert abs(steps[-1] - 1) < 1e-9


def test_shares_reach_their_targets(spark):
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "small").alias("source")
    )
    out = mixing.mixed(docs, {"big": 1.0, "small": 3.0}, total=0.5)
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(got) == {"big", "small"}
    assert abs(got["big"] - 5_000) < 5 * 5_000**0.5 and abs(got["small"] - 15_000) < 5 * 15_000**0.5
    per_doc = out.filter("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("c")).groupBy("c").count().collect()
    rate, seen = 15_000 / 8_000, {r.c: r["count"] for r in per_doc}
    for k in range(1, 5):
        want = 8_000 * math.exp(-rate) * rate**k / math.factorial(k)
        assert abs(seen[k] - want) < 5 * want**0.5


def test_same_mixture_at_any_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    a, b = (mixing.mixed(docs.repartition(n)).select("doc_id", "copy", "shuffle_key").collect() for n in (1, 7))
    assert sorted(a) == sorted(b)
    assert len({r.shuffle_key for r in a}) == len(a)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, None, 9), (1, None, None, 9), (None, "t", "a", 8), (2, "", "a", 7), (3, "x" * 300_000, "a", 6)],
        "doc_id long, text string, source string, copy int",
    )
    out = mixing.mixed(docs, total=20.0)
    assert out.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    counts = {(r.doc_id, r.source): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}
    assert set(counts) == {(1, None), (None, "a"), (2, "a"), (3, "a")} and counts[1, None] % 2 == 0
    assert mixing.mixed(docs, {}).count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
