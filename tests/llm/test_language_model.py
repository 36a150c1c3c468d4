"""Language model: exact base score, gradients by differences, windows against one by one."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from evenkeel.llm import attention as a, language_model as lm, queries

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def small_model(ranks=7, kinds=3, seed=0):
    rng = np.random.default_rng(seed)
    unigrams = rng.random((kinds, ranks))
    model = a.Model.start(unigrams / unigrams.sum(axis=1, keepdims=True), a.bigram_experts(rng.poisson(2.0, (kinds, ranks, ranks)).astype(float)))
    return model.with_trained([rng.normal(0, 0.7, t.shape) for t in model.trained])


def test_base_scores_and_counts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    words = {d: t.encode().lower().split() for d, t in texts.items()}
    c, n_texts = Counter(), sum(not h for h in held.values())
    for d, w in words.items():
        if not held[d]:
            c.update(w)
    n, v = sum(c.values()) + n_texts, len(c) + 1
    rows = queries.op4_language_model(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts = [c[w] for w in words[r.doc_id]] + [n_texts]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(counts), sum(x > 0 for x in counts), n)
        assert r.base_score == pytest.approx(sum(np.log10((x + 1) / (n + v + 1)) for x in counts), rel=1e-9)
        assert r.score < 0
    # Better than chance by far: shuffled subwords would take about 3 more per word.
    assert sum(r.score for r in rows if r.held_out) / sum(r.n_tokens for r in rows if r.held_out) > -4.6


def test_experts_are_distributions():
    experts = a.bigram_experts(np.random.default_rng(1).poisson(0.4, (3, 9, 9)).astype(float))
    assert np.allclose(experts.sum(axis=1), 1, atol=1e-5) and (experts > 0).all()


def test_gradients_are_those_of_differences():
    model = small_model()
    rng = np.random.default_rng(4)
    s = rng.integers(0, 7, (3, 9))
    scored = (rng.random((3, 8)) < 0.8).astype(np.float64)
    gradients, before = model.gradients(s[:, :-1], s[:, 1:], scored)
    for part, g in zip(model.trained, gradients):
        for at in [tuple(rng.integers(0, n) for n in part.shape) for _ in range(6)]:
            if part.ndim == 1 and part.shape[0] == a.WINDOW:
                at = (at[0] % 8,)
            old = part[at]
            part[at] = old + 1e-5
            after = model.gradients(s[:, :-1], s[:, 1:], scored)[1]
            part[at] = old
            assert -(after - before) / 1e-5 == pytest.approx(g[at], abs=1e-3)


def test_attention_is_causal():
    model = small_model()
    x = np.random.default_rng(2).integers(0, 7, (1, 12))
    y = x.copy()
    y[0, 8:] = (y[0, 8:] + 1) % 7
    assert np.allclose(model.attend(x)[1][0, :8], model.attend(y)[1][0, :8])


@pytest.mark.parametrize("lengths", [[2], [3, 2, 40], [33, 34, 9, 200], [25, 26, 2, 57]])
def test_windows_score_each_subword_once(lengths):
    begins = np.array([True, False, True, False, False, True, False])
    model = small_model().ready(begins)
    rng = np.random.default_rng(5)
    ranks, starts = rng.integers(0, 7, sum(lengths)), np.cumsum([0, *lengths[:-1]])
    p, stop = model.probabilities(ranks, starts, np.ones(len(ranks), bool))
    step = a.WINDOW - a.OVERLAP
    for start, n in zip(starts, lengths):
        s = ranks[start : start + n]
        for t in range(1, n):
            first = 0 if t <= a.WINDOW else -(-(t - a.WINDOW) // step) * step
            weights = model.attend(s[None, first:t])[1][0, -1]
            assert p[start + t] == pytest.approx(float(weights @ model.experts[s[t - 1], s[t]]), rel=1e-4)
            assert stop[start + t] == pytest.approx(float(weights @ model.experts[s[t - 1]][begins].sum(axis=0)), rel=1e-4)


def test_training_helps():
    rng = np.random.default_rng(6)
    counts = np.full((2, 5, 5), 0.5)
    counts[0, :, 1], counts[1, :, 2] = 50, 50  # two kinds of text, told apart by what came before
    model = a.Model.start(np.full((2, 5), 0.2), a.bigram_experts(counts, pull=0.1))
    kind = rng.integers(1, 3, 400)
    s = np.where(rng.random((400, a.WINDOW + 1)) < 0.9, kind[:, None], rng.integers(0, 5, (400, a.WINDOW + 1)))
    ones = np.ones((400, a.WINDOW))
    before = model.gradients(s[:, :-1], s[:, 1:], ones)[1]
    after = model.train(s).gradients(s[:, :-1], s[:, 1:], ones)[1]
    assert after > before + 0.1 * ones.sum()


def test_kinds_of_text_are_told_apart():
    rng = np.random.default_rng(7)
    rows = np.vstack([rng.poisson([9, 1, 0.2, 0.2], (60, 4)), rng.poisson([0.2, 0.2, 1, 9], (60, 4))]).astype(float)
    top = a.kinds_of_text(rows, 2).argmax(axis=1)
    assert sorted(top) == [0, 3]


def test_edges(spark):
    rows = [(1, None, 0.5), (1, None, 0.5), (None, "a b", 0.1), (3, "x" * 200_000, 0.2), (4, "", 0.2), (5, "the the the", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    out = lm.language_scores(docs, PATH).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in out), key=repr) == sorted([(1, 1), (1, 1), (None, 3), (3, 2), (4, 1), (5, 4)], key=repr)
    assert all(np.isfinite([r.score, r.base_score]).all() and r.score <= 0 for r in out)
    assert lm.language_scores(docs.limit(0), PATH).count() == 0


def test_every_subword_of_every_text_is_learned_from(spark):
    texts = [" ".join(f"w{i * k % 97} and" for i in range(n)) for k, n in [(1, 3), (5, 400), (7, 5000)]] + ["", None]
    counts, scorer = lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"), PATH)
    # Spark runs the same functions here, so what they see is counted.
    passages = [bytes(r.ranks) for r in spark.createDataFrame([(t,) for t in texts], "text string").mapInArrow(lm._passages(spark.sparkContext.broadcast(scorer.ranks), PATH), "ranks binary").collect()]
    rows = lm.rows_of(passages)
    laid = [[scorer.ranks.end_id, *(i for w in lm.words_of(t) for i in np.frombuffer(lm.ids_of(w, PATH), np.uint16)), scorer.ranks.end_id] for t in texts]
    want = Counter(p for s in laid for p in zip(scorer.ranks.of[s].tolist(), scorer.ranks.of[s][1:].tolist()))
    for found in (rows, lm.windows_of(rows)):
        assert Counter(zip(found[:, :-1][found[:, 1:] >= 0].tolist(), found[:, 1:][found[:, 1:] >= 0].tolist())) == want
    out = spark.createDataFrame([(p,) for p in passages], "ranks binary").mapInArrow(
        lm._pairs(spark.sparkContext.broadcast(np.full((lm.KINDS, lm.RANKS + 1), 1 / lm.RANKS))), "kind int, previous int, next int, n double"
    ).collect()
    total = Counter()
    for r in out:
        total[r.previous, r.next] += r.n
    assert total == want


def test_pairs_anywhere_in_a_long_text_are_known(spark):
    words = [w for w in (f"{a}{b}" for a in "bcdfghklmnprst" for b in "aeiou") if len(lm.ids_of(w.encode(), PATH)) == 2][:40]
    text = " ".join(f"{a} {b}" for a, b in zip(words[::2], words[1::2]) for _ in range(60))
    _, scorer = lm.fit(spark.createDataFrame([(text,)], "text string"), PATH)
    rank = [int(scorer.ranks.of[np.frombuffer(lm.ids_of(w.encode(), PATH), np.uint16)[0]]) for w in words]
    assert len(rank) > 20 and all(scorer.model.experts[a, b].max() > 0.5 for a, b in zip(rank[::2], rank[1::2]))


@pytest.mark.parametrize("held", [0, 30])
def test_scores_do_not_depend_on_the_dictionary(spark, monkeypatch, held):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.4, 60) % 500)) for i in range(60)]
    docs = spark.createDataFrame([*texts, (60, "x" * 70 + " never seen"), (61, "")], "doc_id long, text string")
    want = {r.doc_id: r for r in lm.language_scores(docs, PATH).collect()}
    monkeypatch.setattr(lm, "FREQUENT", held)
    found = {r.doc_id: r for r in lm.language_scores(docs, PATH).collect()}
    assert found.keys() == want.keys()
    for d, r in found.items():
        assert tuple(r)[:5] == tuple(want[d])[:5] and r.base_score == pytest.approx(want[d].base_score, rel=1e-9)
        assert r.score == pytest.approx(want[d].score, rel=1e-5)


def test_kinds_come_from_all_passages(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE", 8)
    rng = np.random.default_rng(9)
    draw = lambda lo: rng.integers(lo, lo + 20, lm.PASSAGE + 1).astype("<u2").tobytes()
    places = [100 * k for k in range(lm.KINDS)]
    rows = [draw(lo) for lo in places for _ in range(50)] + [draw(0)] * 5000  # one passage has many copies
    hashed = spark.createDataFrame([(r,) for r in rows], "ranks binary")
    found = lm.kinds_of_all(hashed)
    assert np.allclose(found.sum(axis=1), 1)
    # The copies are but one passage of the start, and all others count in the rounds.
    assert len({int(row.argmax()) // 100 for row in found}) > 1
    everything = np.bincount(lm.rows_of(rows)[:, 1:].ravel(), minlength=lm.RANKS + 1)
    assert all(found[:, r].max() > 1e-4 for r in np.flatnonzero(everything))


def test_sums_over_the_experts_have_the_bits_of_numpys_own():
    """Scores don't depend on how these are computed; of one expert too."""
    rng = np.random.default_rng(7)
    for k in (1, 2, lm.KINDS, 7):
        x = rng.normal(0, 3, (5, 32, k)).astype(np.float32)
        assert (a.over_experts(np.add, x) == x.sum(axis=2, keepdims=True)).all()
        assert (a.over_experts(np.maximum, x) == x.max(axis=2, keepdims=True)).all()
