"""Classifier: held-out accuracy, the discriminant against a plain formula, edges."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from evenkeel.llm import classifier as c, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op1_quality_classifier(spark, sf).collect()}
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for d, r in found.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    labels = [(r.quality, found[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if found[r.doc_id].held_out]
    assert np.mean([q == r.predicted for q, r in labels]) > 0.97
    good, bad = ([r.score for q, r in labels if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_labels_held_out_are_not_learned_from(spark):
    docs = spark.createDataFrame([(i, "good text here " * 20 if i % 2 else "### $$$ " * 9) for i in range(200)], "doc_id long, text string")
    honest = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    lying = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in c.classify(docs, x).collect()} for x in (honest, lying))
    assert all(abs(a[d] - b[d]) < 1e-9 for d in a) and a[1] > 0.9 > 0.1 > a[2]


def test_score_is_the_ratio_of_two_normal_densities():
    rng = np.random.default_rng(3)
    means, spreads = [rng.normal(size=3) for _ in range(2)], []
    for _ in range(2):
        a = rng.normal(size=(3, 3))
        spreads.append(a @ a.T + np.eye(3))
    model = c.Discriminant(means, [np.linalg.cholesky(s) for s in spreads], 0.4)
    x = rng.normal(size=(5, 3))
    log = [-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m) - 0.5 * np.log(np.linalg.det(s)) for m, s in zip(means, spreads)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(0.4 + c.TEMPER * (log[1] - log[0])))))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, None, 0.5), (None, "", 0.1), (3, "x " * 400_000, 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (9, 0), (None, 1), (3, 7)], "doc_id long, quality int")
    rows = c.classify(docs, labels).collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert c.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in c.classify(docs, labels.limit(0)).collect()} == {0.5}


def plain_statistics(text):
    """The statistics once more, by expressions over the text."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size = max(1, len(words)), max(1, len(raw))
    found = lambda pattern: len(re.findall(pattern, raw))
    triples = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    distinct = len(set(triples)) if triples else 1
    windows = max(1, len(words) - 2)
    lines = Counter(line for line in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", line))
    return [
        np.log(1 + len(words)),
        np.log(max(1, sum(len(w) for w in words)) / n),
        np.log(1 + 10 * found(rb"[#*$%&|<>]") / n),
        np.log(1 + 10 * found(rb"[!?.,;:]") / n),
        (found(rb"[A-Z]") / size) ** 0.5,
        (found(rb"[0-9]") / size) ** 0.5,
        np.log(max(1, len(set(words)))) - 0.9 * np.log(n),
        (max(0, windows - distinct) / windows) ** 0.5,
        (sum(k - 1 for k in lines.values()) / max(1, sum(lines.values()))) ** 0.5,
    ]


def test_whole_query_against_a_plain_version(spark):
    """Statistics, estimates, densities and scores of every document, without Spark and without
    Cholesky factors."""
    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas()
    x = np.array([plain_statistics(t) for t in docs.text])
    place = {d: i for i, d in enumerate(docs.doc_id)}
    learned = [(place[d], q) for d, q in zip(labels.doc_id, labels.quality) if d in place and zlib.crc32(str(d).encode()) % 4 != 2 and q in (0, 1)]
    sides = [x[[i for i, q in learned if q == k]] for k in (0, 1)]
    assert min(map(len, sides)) > 0
    spreads = [np.cov(s, rowvar=False, bias=True) for s in sides]
    pooled = sum(len(s) * v for s, v in zip(sides, spreads)) / len(learned)
    log = []
    for s, v in zip(sides, spreads):
        mix = 0.7 * v + 0.1 * pooled + 0.2 * np.diag(v.diagonal()) + 0.05**2 * np.eye(x.shape[1])
        off = x - s.mean(axis=0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(mix), off) - 0.5 * np.linalg.slogdet(mix)[1])
    margin = np.log((len(sides[1]) + 1) / (len(sides[0]) + 1)) + 0.25 * (log[1] - log[0])
    want = dict(zip(docs.doc_id, 1 / (1 + np.exp(-np.clip(margin, -700, 700)))))
    got = {r.doc_id: r.score for r in queries.op1_quality_classifier(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[d] - want[d]) for d in got) < 1e-6
