"""Scoring texts by a language model that is trained here.

A text is lower-cased words and one end. What is gathered from the training texts grows with them:
how often each word occurs, and every text as passages of subword ranks that follow each other.
From these come: the frequent words with their counts (a bounded dictionary), the subwords that
get a rank of their own, bigram tables for several kinds of text, and an attention model that
weighs these (see attention.py). Every subword of every text is in one passage, and is counted and
trained on there, given the one before it.

The probability of a word is a mixture of its share among all words and of the attention
model's probability of its subwords and of the word's ending there. Both scores need the count of
every word: frequent words are looked up in the dictionary, all others are joined with the table of
counts and mixed there, so neither the dictionary nor a join's hot keys grow with the corpus, and
no score depends on what the dictionary holds.
"""

from __future__ import annotations

import base64
from array import array
from collections import Counter
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm.attention import WINDOW, Model, bigram_experts, kinds_of_text
from evenkeel.llm.bpe import Remembered, slices
from evenkeel.llm.classifier import held_out
from evenkeel.session import ship_package, stored

FREQUENT, LONGEST = 200_000, 64  # dictionary: at most so many words of at most so many bytes
RANKS = 1024  # subwords with a rank of their own; the rest share one more
KINDS = 6  # kinds of text
PASSAGE = 2 * WINDOW  # subwords of a passage, besides the one before it
SAMPLE = 3000  # different passages from which the rounds that find the kinds of text start
ROUNDS, GAIN = 25, 1e-4  # such rounds over all passages at most, and the relative gain of one that ends them
SHARE = 0.5  # of the words' own shares in a word's probability
WHOLE_WORDS = 400_000  # distinct words that a task counts before it passes them on


@cache
def subwords(path: str) -> tiktoken.Encoding:
    # Fixed value: the pattern that belongs to the rank file.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def begins_word(path: str) -> np.ndarray:
    """By id: whether the subword begins with the blank before a word; the end counts as a word."""
    enc = subwords(path)
    return np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(enc.n_vocab)] + [True])


def words_of(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) words; both steps are about ASCII only."""
    return (text or "").encode().lower().split()


def ids_of(word: bytes, path: str) -> bytes:
    return array("H", subwords(path).encode_ordinary(" " + word.decode())).tobytes()


def _gathered(batches):
    """(word, n) of the texts."""
    counts: Counter[bytes] = Counter()

    def out():
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()

    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            counts.update(words_of(text))
        if len(counts) > WHOLE_WORDS:
            yield from out()
    yield from out()


def _with_ids(path: str):
    def run(batches):
        for batch in batches:
            ids = [ids_of(w, path) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, "ids"])

    return run


def _id_counts(batches):
    total = np.zeros(1 << 16)
    for batch in batches:
        ids = [np.frombuffer(b, np.uint16) for b in batch.column(1).to_pylist()]
        if ids:
            n = np.repeat(batch.column(0).to_numpy(), [len(i) for i in ids])
            total += np.bincount(np.concatenate(ids), weights=n, minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen].astype(np.int64))], ["id", "n"])


class Ranks:
    """Ranks of ids by their counts: the frequent ones, the end, and one for all others."""

    def __init__(self, counts: np.ndarray):
        self.end_id = len(counts)
        order = np.argsort(-counts, kind="stable")[: RANKS - 1]
        self.end, self.other = RANKS - 1, RANKS
        self.of = np.full(len(counts) + 1, self.other)
        self.of[order], self.of[self.end_id] = np.arange(len(order)), self.end
        rare = np.flatnonzero(self.of == self.other)
        self.within = np.zeros(len(counts) + 1)
        self.within[rare] = np.log10((counts[rare] + 1) / (counts[rare].sum() + len(rare)))


def _passages(sent, path: str):
    """The passages of whole texts, as little-endian 16-bit ranks: a text is laid out as in
    scoring, between two ends, and each passage begins with the last rank of the one before it."""

    def run(batches):
        ranks = sent.value
        ids = Remembered(lambda w: ids_of(w, path), 100_000)
        end = np.array([ranks.end], "<u2")
        of = ranks.of.astype("<u2")
        for batch in slices(batches):
            out = []
            for text in batch.column(0).to_pylist():
                flat = np.frombuffer(b"".join([ids[w] for w in words_of(text)]), np.uint16)
                r = np.concatenate([end, of[flat], end]).tobytes()
                out += [r[at : at + 2 * PASSAGE + 2] for at in range(0, len(r) - 2, 2 * PASSAGE)]
                ids.turn()
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ranks"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ranks"])

    return run


def rows_of(passages: list[bytes]) -> np.ndarray:
    """Passages as rows of PASSAGE + 1 ranks; -1 fills the last ones of a text up."""
    lengths = np.array([len(p) // 2 for p in passages], np.int64)
    out = np.full((len(passages), PASSAGE + 1), -1, np.int16)
    out[np.arange(PASSAGE + 1) < lengths[:, None]] = np.frombuffer(b"".join(passages), "<u2")
    return out


def windows_of(rows: np.ndarray) -> np.ndarray:
    """The rows' windows of WINDOW + 1 ranks, without those that score nothing."""
    out = np.stack([rows[:, at : at + WINDOW + 1] for at in range(0, PASSAGE, WINDOW)], axis=1).reshape(-1, WINDOW + 1)
    return out[out[:, 1] >= 0]


def histograms_of(rows: np.ndarray) -> np.ndarray:
    return np.array([np.bincount(r[r >= 0], minlength=RANKS + 1) for r in rows[:, 1:]], float).reshape(-1, RANKS + 1)


def _with_zero(log: np.ndarray) -> np.ndarray:
    """[rank, k] with zeros at -1, from [k, rank]."""
    return np.concatenate([log.T, np.zeros((1, len(log)))])


def _least(batches):
    """The SAMPLE different passages of the least hashes (columns ranks, h)."""
    kept: dict[int, bytes] = {}
    for batch in batches:
        kept.update(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()))
        kept = {h: kept[h] for h in sorted(kept)[:SAMPLE]}
    yield pa.RecordBatch.from_arrays([pa.array(list(kept.values()), pa.binary()), pa.array(list(kept), pa.int64())], ["ranks", "h"])


def _kind_sums(sent):
    """A round over a task's passages, as rows (kind, rank, n): subwords by kind; at rank -1 the
    passages by kind, at kind -1 the log likelihood."""

    def run(batches):
        unigrams, weights = sent.value
        log, prior = _with_zero(np.log(unigrams)), np.log(weights)
        total, passages, likelihood = np.zeros((KINDS, RANKS + 1)), np.zeros(KINDS), 0.0
        for batch in slices(batches, 1024):
            rows = rows_of(batch.column(0).to_pylist())[:, 1:].astype(np.int64)
            share = log[rows].sum(axis=1) + prior
            top = share.max(axis=1, keepdims=True)
            share = np.exp(share - top)
            sums = share.sum(axis=1, keepdims=True)
            share /= sums
            passages += share.sum(axis=0)
            likelihood += float((top + np.log(sums)).sum())
            scored = rows >= 0
            flat, of = rows[scored], np.repeat(np.arange(len(rows)), scored.sum(axis=1))
            for k in range(KINDS):
                total[k] += np.bincount(flat, share[of, k], RANKS + 1)
        k, r = np.nonzero(total)
        arrays = [np.r_[k, range(KINDS), -1], np.r_[r, [-1] * (KINDS + 1)], np.r_[total[k, r], passages, likelihood]]
        yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, [pa.int32(), pa.int32(), pa.float64()])], ["kind", "rank", "n"])

    return run


def kinds_of_all(passages: DataFrame) -> np.ndarray:
    """[kind, rank]: as ``kinds_of_text``, which only gives the start, but fitted to all passages."""
    spark = passages.sparkSession
    least = passages.select("ranks", F.xxhash64("ranks").alias("h")).mapInArrow(_least, "ranks binary, h long")
    sample = [bytes(r.ranks) for r in least.distinct().orderBy("h").limit(SAMPLE).collect()]
    unigrams, weights, before = kinds_of_text(histograms_of(rows_of(sample)), KINDS), np.full(KINDS, 1 / KINDS), -np.inf
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((unigrams, weights))
        sums = passages.mapInArrow(_kind_sums(sent), "kind int, rank int, n double")
        table = sums.groupBy("kind", "rank").agg(F.sum("n").alias("n")).toArrow()  # a row per kind and rank at most
        sent.unpersist()
        kind, rank, n = (table.column(c).to_numpy() for c in range(3))
        counts = np.zeros((KINDS, RANKS + 1))
        counts[kind[rank >= 0], rank[rank >= 0]] = n[rank >= 0]
        number = np.zeros(KINDS)
        number[kind[(rank < 0) & (kind >= 0)]] = n[(rank < 0) & (kind >= 0)]
        likelihood = float(n[kind < 0].sum())
        if not number.any() or likelihood - before < GAIN * abs(likelihood):
            break
        before = likelihood
        smooth = counts.sum(axis=0) + 1.0
        weights = (number + 1) / (number.sum() + KINDS)
        unigrams = counts + 5 * smooth / smooth.sum()
        unigrams /= unigrams.sum(axis=1, keepdims=True)
    return unigrams


def _pairs(sent):
    """Bigram counts of the passages by kind of text, as rows (kind, previous, next, n)."""

    def run(batches):
        total = np.zeros(KINDS * (RANKS + 1) ** 2)
        log = _with_zero(np.log(sent.value))
        for batch in slices(batches, 1024):
            rows = rows_of(batch.column(0).to_pylist()).astype(np.int64)
            kind = np.argmax(log[rows[:, 1:]].sum(axis=1), axis=1)
            pair = (kind[:, None] * (RANKS + 1) + rows[:, :-1]) * (RANKS + 1) + rows[:, 1:]
            np.add.at(total, pair[rows[:, 1:] >= 0], 1.0)
        k, a, b = np.nonzero(total := total.reshape(KINDS, RANKS + 1, RANKS + 1))
        arrays = [pa.array(k, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[k, a, b], pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, ["kind", "previous", "next", "n"])

    return run


def _trained(sent):
    """The attention parameters after a pass over all of a task's passages, as rows (place, value, weight)."""

    def run(batches):
        n = 0

        def windows():
            nonlocal n
            for batch in slices(batches, 1024):
                found = windows_of(rows_of(batch.column(0).to_pylist()))
                n += len(found)
                yield found

        flat = np.concatenate([t.ravel() for t in sent.value.train_on(windows()).trained]).astype(float)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat * n), pa.array(np.full(len(flat), float(n)))], ["place", "value", "weight"])

    return run


class Places(dict):
    """Place of a word in the tables of a Scorer; words that aren't there get places after them,
    until they are taken away again."""

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = place = self.known + len(self.new)
        return place

    def begin(self) -> None:
        self.known, self.new = len(self), []

    def take_new(self) -> list[bytes]:
        for word in self.new:
            del self[word]
        return self.new


class Scorer:
    """Everything that scoring needs, of bounded size. In its tables the end stands at place 0 and
    the frequent words after it."""

    def __init__(self, model: Model, ranks: Ranks, frequent: dict[bytes, tuple[int, bytes]], n: int, distinct: int, texts: int):
        self.model, self.ranks = model, ranks
        self.n, self.distinct, self.texts = n, distinct, texts
        self.words = list(frequent)
        self.counts = np.array([texts, *(c for c, _ in frequent.values())])
        ids = [np.array([ranks.end_id], np.uint16).tobytes(), *(i for _, i in frequent.values())]
        self.lengths = np.array([len(i) // 2 for i in ids])
        flat = np.frombuffer(b"".join(ids), np.uint16)
        self.flat_ranks, self.flat_within = ranks.of[flat], ranks.within[flat]

    @cached_property
    def places(self) -> Places:
        return Places((w, k) for k, w in enumerate(self.words, 1))

    def base(self, c) -> float:
        return np.log10((c + 1) / (self.n + self.distinct + 1))


def fit(training: DataFrame, path: str) -> tuple[DataFrame, Scorer]:
    """(counts of all training words, scorer) from a table of one column of texts."""
    spark = training.sparkSession
    ship_package(spark)
    texts = training.count()
    counts = training.mapInArrow(_gathered, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(spark, counts.mapInArrow(_with_ids(path), "word binary, n long, ids binary"), "words")

    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The least count of a frequent word: counts are tallied in half octaves, of which there are few.
    step = F.floor(2 * F.log2("n"))
    tally = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True)
    least, held = 0, 0
    for row in tally:
        held += row.words
        if held > FREQUENT:
            least = row.step + 1
            break
    known = counts.filter((step >= least) & (F.octet_length("word") <= LONGEST)).toArrow()  # FREQUENT rows at most
    frequent = dict(zip(known.column(0).to_pylist(), zip(known.column(1).to_pylist(), known.column(2).to_pylist())))

    id_counts = np.zeros(subwords(path).n_vocab)
    for row in counts.select("n", "ids").mapInArrow(_id_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        id_counts[row.id] = row.n  # at most a row per subword
    ranks = Ranks(id_counts)

    passages = stored(spark, training.mapInArrow(_passages(spark.sparkContext.broadcast(ranks), path), "ranks binary"), "passages")
    unigrams = kinds_of_all(passages)
    pairs = passages.mapInArrow(_pairs(spark.sparkContext.broadcast(unigrams)), "kind int, previous int, next int, n double")
    table = pairs.groupBy("kind", "previous", "next").agg(F.sum("n").alias("n")).toArrow()  # a row per pair of ranks at most
    bigrams = np.zeros((KINDS, RANKS + 1, RANKS + 1))
    bigrams[tuple(table.column(c).to_numpy() for c in range(3))] = table.column(3).to_numpy()
    by_rank = np.zeros(RANKS + 1, bool)
    by_rank[ranks.of] = begins_word(path)  # all ids of a rank agree but for those that share the last one
    model = Model.start(unigrams, bigram_experts(bigrams))

    rows = passages.mapInArrow(_trained(spark.sparkContext.broadcast(model)), "place int, value double, weight double")
    mean = rows.groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow()  # a row per parameter
    if mean.num_rows:
        flat = np.empty(mean.num_rows)
        flat[mean.column(0).to_numpy()] = mean.column(1).to_numpy()
        parts, at = [], 0
        for t in model.trained:
            parts.append(flat[at : at + t.size].reshape(t.shape).astype(np.float32))
            at += t.size
        model = model.with_trained(parts)
    return counts.select("word", "n"), Scorer(model.ready(by_rank), ranks, frequent, total + texts, distinct + (texts > 0), texts)


def score_texts(scorer: Scorer, texts: list[str | None], ids: Remembered):
    """Per text: words and end, known ones of them by the dictionary, base score and score of those,
    and the other words with the attention's log probabilities (offsets, words, logs)."""
    ranks, places = scorer.ranks, scorer.places
    places.begin()
    found, sizes = [], []
    for text in texts:
        own = words_of(text)
        sizes.append(len(own))
        found += map(places.__getitem__, own)
    rare = places.take_new()
    sizes, found = np.array(sizes), np.array(found, np.int64)
    n_known = len(scorer.lengths)

    # The tables with the rare words of these texts after them.
    rare_ids = [ids[w] for w in rare]
    flat = np.frombuffer(b"".join(rare_ids), np.uint16)
    flat_ranks = np.concatenate([scorer.flat_ranks, ranks.of[flat]])
    flat_within = np.concatenate([scorer.flat_within, ranks.within[flat]])
    lengths = np.concatenate([scorer.lengths, np.array([len(i) // 2 for i in rare_ids], np.int64)])
    offsets = np.cumsum(lengths) - lengths

    # Laid end to end: each text begins and ends with the end mark, at place 0.
    text_first = np.cumsum(sizes + 2) - (sizes + 2)
    is_first, is_last = np.zeros((2, len(found) + 2 * len(sizes)), bool)
    is_first[text_first] = is_last[text_first + sizes + 1] = True
    inner = ~(is_first | is_last)
    pieces = np.zeros(len(inner), np.int64)
    pieces[inner] = found
    n = lengths[pieces]
    piece_start = np.cumsum(n) - n
    at = np.repeat(offsets[pieces] - piece_start, n) + np.arange(n.sum())
    starts = piece_start[text_first]
    ending = np.zeros(len(at), bool)
    ending[piece_start] = True
    p, stop = scorer.model.probabilities(flat_ranks[at], starts, ending)
    log = np.log10(np.maximum(p, 1e-30)) + flat_within[at]
    log[starts] = 0
    log_stop = np.log10(np.clip(stop[piece_start], 1e-30, 1))
    # A word: its first subword given that a word begins, the others, and its ending where the next piece begins.
    piece_log = np.add.reduceat(log, piece_start) - log_stop
    piece_log += np.where(is_last, 0.0, np.r_[log_stop[1:], 0.0])
    count = np.concatenate([scorer.counts, np.zeros(len(rare), np.int64)])[pieces]
    share = SHARE * count / max(1, scorer.n)
    # Beyond the range of a double the larger part alone is the answer.
    own = np.log10(1 - SHARE) + piece_log
    mixed = np.where(piece_log > -290, np.log10(share + (1 - SHARE) * 10 ** np.maximum(piece_log, -300)), np.where(share > 0, np.log10(np.maximum(share, 1e-300)), own)) if scorer.n else piece_log
    is_rare = pieces >= n_known
    mixed[is_first | is_rare] = 0
    base = np.where(is_first | is_rare, 0.0, scorer.base(count))
    known = (count > 0) & ~is_first

    # Rare words by text, each as often as it occurs.
    among = found >= n_known
    cuts = np.r_[0, np.cumsum(among)][np.r_[0, np.cumsum(sizes)]]
    return (
        sizes + 1, np.add.reduceat(known.astype(np.int64), text_first), np.add.reduceat(base, text_first),
        np.add.reduceat(mixed, text_first), (cuts, [rare[k] for k in (found[among] - n_known).tolist()], piece_log[inner][among]),
    )


def mixture(n: Column, log: Column, total: int) -> Column:
    """As in ``score_texts``: log probability of a word with its count and the attention's one."""
    if not total:
        return log
    share = SHARE * n / F.lit(float(total))
    alone = F.when(share > 0, F.log10(F.greatest(share, F.lit(1e-300)))).otherwise(float(np.log10(1 - SHARE)) + log)
    return F.when(log > -290, F.log10(share + (1 - SHARE) * F.pow(F.lit(10.0), F.greatest(log, F.lit(-300.0))))).otherwise(alone)


def _scored(sent, path: str):
    rest_type = pa.struct([("word", pa.binary()), ("log", pa.float64())])

    def run(batches):
        scorer = sent.value
        ids = Remembered(lambda w: ids_of(w, path), 100_000)
        # Unique among the rows of this table, which is written before it is used.
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            tokens, known, base, score, (cuts, words, logs) = score_texts(scorer, batch.column(0).to_pylist(), ids)
            ids.turn()
            n = batch.num_rows
            rest = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(logs, pa.float64())], fields=list(rest_type))
            rest = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column(1), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score), rest],
                ["row", "id", "n_tokens", "n_known", "base", "score", "rest"],
            )
            row += n

    return run


def language_scores(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Learned from the rows where ``train`` (by default: not held out, by the id's hash) is true.
    Null texts count as empty: one token, the end. Rows with a null id are scored and not held out;
    rows that repeat an id are scored each.
    """
    spark = docs.sparkSession
    out = held_out(F.col("id"), 7)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    counts, scorer = fit(rows.filter(~out if train is None else train).select("text"), path)
    sent = spark.sparkContext.broadcast(scorer)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, n_tokens long, n_known long, base double, score double, rest array<struct<word:binary,log:double>>"
    found = stored(spark, rows.mapInArrow(_scored(sent, path), schema), "scored")
    rare = found.select("row", F.explode("rest").alias("r")).select("row", "r.word", F.col("r.log").alias("log"))
    c = F.coalesce("n", F.lit(0))
    base = F.log10((c + 1) / F.lit(float(scorer.n + scorer.distinct + 1)))
    added = (
        rare.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(base).alias("more"), F.count_if(c > 0).alias("more_known"),
            F.sum(mixture(c, F.col("log"), scorer.n)).alias("more_score"),
        )
    )
    narrow = found.select("row", "id", "n_tokens", "n_known", "base", "score")
    return narrow.join(added, "row", "left").select(
        F.col("id").alias(id_col), out.alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(scorer.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
