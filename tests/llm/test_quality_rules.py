"""Quality rules: counts by hand, the estimate against numpy, the query against its SQL."""

import collections

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from oracle import database, differences
from pyspark.sql import functions as F

from evenkeel.llm import quality_rules as q, queries

SF = "/root/testdata/sf0.001"


def plain_counts(text):
    words = (text or "").encode().split()
    windows = list(zip(words, words[1:], words[2:]))
    times, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered),
    )


def test_query_agrees_with_its_sql(spark):
    assert differences(queries.op7_quality_rules(spark, SF), database(SF), queries.SQL["op7_quality_rules"]) == []


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab\n \t\x0b|#é "), max_size=40), min_size=1, max_size=20))
def test_counts(spark, texts):
    docs = spark.createDataFrame(list(enumerate([*texts, None, "x y z " * 400])), "doc_id long, text string")
    for r in q.word_counts(docs).select("doc_id", "text", *q.COUNTS).collect():
        assert tuple(r)[2:] == plain_counts(r.text)


def test_limits_are_those_of_the_distribution():
    assert abs(q.chi_square(2, 2.0) - (1 - np.exp(-1))) < 1e-12
    assert abs(q.chi_square_quantile(4, 0.9999) - 23.5127) < 1e-3


def test_estimate_ignores_outliers(spark):
    rng = np.random.default_rng(5)
    good = rng.multivariate_normal([1.6, 0.0, 0.05, 0.02], np.diag([0.04, 0.01, 0.01, 0.02]), 2000)
    bad = rng.normal([4.0, 1.2, 0.4, 0.3], 0.05, (500, 4))
    rows = [("en", "s", *map(float, r), False) for r in np.vstack([good, bad])]
    found = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double, base_failed boolean")
    estimate = q.fit(found)
    e = estimate.first()
    assert np.allclose([e.m0, e.m1, e.m2, e.m3], good.mean(0), atol=0.03)
    lower = np.array([[e[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    want = np.cov(good.T) + np.diag([f**2 for f in q.FLOORS.values()])
    assert np.allclose(np.diag(lower @ lower.T), np.diag(want), rtol=0.35)
    assert np.isclose(e.log_det, np.linalg.slogdet(lower @ lower.T)[1])
    judged = q.judged(found, estimate).select("x1", "kept").collect()
    assert not any(r.kept for r in judged if r.x1 > 0.9)
    assert np.mean([r.kept for r in judged if r.x1 < 0.6]) > 0.995


STATS = "lang string, source string, x0 double, x1 double, x2 double, x3 double, base_failed boolean"


def clusters(spark, *parts):
    """Measured rows (lang, source, mean, spread, number): clusters of documents, and their number."""
    rng, rows = np.random.default_rng(8), []
    for k, (lang, source, mean, spread, n) in enumerate(parts):
        rows += [(lang, source, *map(float, x), False, k) for x in rng.normal(mean, spread, (n, 4))]
    return spark.createDataFrame(rows, STATS + ", cluster int")


GOOD = [1.6, 0.0, 0.05, 0.02]


@pytest.mark.parametrize("share", [0.2, 0.3, 0.4, 0.45])
def test_junk_of_a_bad_source_goes(spark, share):
    n = 2000
    found = clusters(spark, ("en", "bad", GOOD, 0.08, n), ("en", "bad", [3.0, 1.0, 0.3, 0.3], 0.05, round(n * share / (1 - share))), ("en", "good", GOOD, 0.08, 500))
    kept = {r.cluster: r.k for r in q.judged(found, q.fit(found)).groupBy("cluster").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[0] > 0.99 and kept[1] < 0.05 and kept[2] > 0.99


def test_two_kinds_of_junk_in_one_source(spark):
    found = clusters(spark, ("en", "a", GOOD, 0.08, 1200), ("en", "a", [3.0, 1.0, 0.3, 0.3], 0.05, 400), ("en", "a", [0.2, 0.0, 0.0, 0.9], 0.05, 400))
    kept = {r.cluster: r.k for r in q.judged(found, q.fit(found)).groupBy("cluster").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[0] > 0.99 and kept[1] < 0.05 and kept[2] < 0.05


def test_small_sources_are_no_outliers_for_their_size(spark):
    rows = [("en", s, *GOOD[:1], d, 0.05, 0.02, False) for s, d in (("a", 0.0), ("a", 0.01), ("a", 0.02), ("b", 0.3), (None, 0.1), ("", 0.1))]
    found = spark.createDataFrame(rows, STATS)
    assert all(r.kept for r in q.judged(found, q.fit(found)).collect())
    assert {r.part for r in q.fit(found).collect()} == {"=a", "=b", "=", "-"}  # null and empty sources are apart


def test_the_determinant_only_falls(spark):
    """Against plain concentration steps in numpy from the same starts: none finds a lower one."""
    found = clusters(spark, ("en", "a", GOOD, [0.2, 0.1, 0.1, 0.1], 600), ("en", "a", [2.2, 0.4, 0.2, 0.2], 0.1, 300))
    x = np.array([[r.x0, r.x1, r.x2, r.x3] for r in found.collect()])
    floors = np.diag([f**2 for f in q.FLOORS.values()])
    half = (len(x) + 5) // 2

    def moments(part):
        return part.mean(0), q.CONSISTENCY * np.cov(part.T, bias=True) + floors

    rng, least = np.random.default_rng(1), np.inf
    for _ in range(50):
        m, c = moments(x[rng.choice(len(x), 10, replace=False)])
        for _ in range(50):
            m, c = moments(x[np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))[:half]])
        least = min(least, np.linalg.slogdet(c)[1])
    spread = q.SHRINK
    try:
        q.SHRINK = 0
        e = q.fit(found).first()
    finally:
        q.SHRINK = spread
    assert e.log_det < least + 0.05


def test_clean_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: r for r in q.verdicts(docs).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [found[r.doc_id] for r in labels if r.quality == 1 and not found[r.doc_id].base_failed]
    bad = [found[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.99
    assert np.mean([r.kept for r in bad]) < 0.05


@pytest.mark.parametrize("rows", [0, 4])
def test_edges(spark, rows):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(None, text, None, "a", 1), (1, None, "en", None, 2), (2, "", "en", "a", 3), (3, text * 2000, "en", "a", 4)][:rows],
        "doc_id long, text string, lang string, source string, n_words int",
    )
    out = {r.doc_id: r for r in q.verdicts(docs).collect()}
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns and len(out) == rows
    if rows:
        assert out[None].kept and not out[1].kept and not out[2].kept and out[1].n_words == 0
        assert {(r.doc_id, r.n_words) for r in kept.collect()} == {(None, 1)} | ({(3, 4)} if out[3].kept else set())
    else:
        assert kept.count() == 0
