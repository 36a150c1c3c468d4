"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

A row's score for an anchor is the inner product of their vectors in whole numbers. An anchor's
positives are its best rows of the same label; its negatives are the best rows of other labels
whose score lies in a window that each positive sets.

Anchors and rows are cut into blocks; every pair of blocks is a tile, and Spark deals tiles to
tasks. Both searches are threshold joins within a tile (``Tile``): all pairs of at least a
threshold, which starts high and is lowered until the anchor's windows are full or their lower
ends are reached; what is kept from the pieces before raises it for the next. Such a join goes
through an index of its own (``Postings``):

- Dimensions are taken in order of their weight. A row's last dimensions are left out of the
  index where their norm alone says that they cannot lift a pair to the threshold; a row whose
  whole norm is too small has no entry at all.
- Partial scores are added up dimension by dimension, and a pair is dropped as soon as its partial
  score and the norms of what remains stay below the threshold.
- What is left is completed by the dimensions that the index left out.

All bounds are upper bounds, so the results are those of comparing every pair. Tiles give at most
a few rows per anchor and window, which are merged per anchor.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.session import ship_package, stored

ANCHOR_BLOCK, ROW_BLOCK = 1 << 15, 1 << 19  # anchors are held by a task, rows are streamed past them
PAIRS = 1 << 21  # pairs that are worked on at a time
STRIDE = 16  # dimensions that are added up between two looks at the bounds
STARTS = (0.8, 0.7, 0.6, 0.5, 0.0)  # thresholds, as parts of the way from a window's lower end to its upper one
SCALE = 256
LARGEST = 2.0**62  # rows whose squared length reaches it have no scores of 64 bits
SLACK = 1e-9  # relative room for the rounding of the bounds
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Postings:
    """The rows of a piece, their dimensions by falling weight, with the norms of what remains
    after every STRIDE of them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels = ids, labels
        self.turn = np.argsort(-(vectors**2).sum(axis=0), kind="stable")
        self.vectors = vectors[:, self.turn]
        self.cuts = [*range(0, vectors.shape[1], STRIDE), vectors.shape[1]]
        self.rest = self.norms(self.vectors)

    def norms(self, vectors: np.ndarray) -> np.ndarray:
        """A column per cut: the length of the dimensions from there on."""
        parts = [(vectors[:, a:b] ** 2).sum(axis=1) for a, b in zip(self.cuts, self.cuts[1:])]
        squares = np.cumsum(np.stack([*parts, np.zeros(len(vectors))], axis=1)[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(squares) * (1 + SLACK)

    def pairs(self, anchors: np.ndarray, threshold: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of every allowed pair whose score is at least the anchor's threshold."""
        anchors = anchors[:, self.turn]
        rest = self.norms(anchors)
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(rest[:, 0] > 0, threshold / rest[:, 0], np.where(threshold > 0, np.inf, -np.inf)).min()
        depth = (self.rest[:, :-1] >= least).sum(axis=1)  # parts of a row that are in the index
        turn = np.argsort(-depth, kind="stable")
        depth, rows, row_rest = depth[turn], self.vectors[turn], self.rest[turn]
        alive = allowed[:, turn]
        # Sums of whole numbers are exact in double precision below 2^53, else in 64-bit integers.
        exact = rest[:, 0].max(initial=0) * row_rest[:, 0].max(initial=0) < 2**53
        kind = np.float64 if exact else np.int64
        x, y = anchors.astype(kind), rows.astype(kind)
        score = np.zeros(alive.shape, kind)
        alive[:, row_rest[:, 0] < least] = False  # not in the index
        for part, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            n = int(np.searchsorted(-depth, -part))  # rows with more than ``part`` parts come first
            if not n:
                break
            score[:, :n] += x[:, a:b] @ y[:n, a:b].T
            upper = score[:, :n] + rest[:, part + 1, None] * row_rest[None, :n, part + 1]
            upper += SLACK * np.abs(upper)
            alive[:, :n] &= upper >= threshold[:, None]
        at, row = np.nonzero(alive)
        found = score[at, row].astype(np.int64)
        for part in np.unique(depth):
            if part < len(self.cuts) - 1:  # dimensions that the index left out
                some, first = np.flatnonzero(depth[row] == part), self.cuts[part]
                found[some] += (x[at[some], first:].astype(np.int64) * y[row[some], first:].astype(np.int64)).sum(axis=1)
        good = found >= threshold[at]
        return at[good], turn[row[good]], found[good]


class Tile:
    """What anchors keep of the rows of a tile: per anchor and window the k best rows in it.

    ``same`` asks for rows of the anchor's label, else for rows of all others; ``low`` and ``high``
    hold the ends of each anchor's windows, a window whose ends are the wrong way round is empty.
    """

    def __init__(self, ids, labels, vectors, low, high, k: int, same: bool):
        self.ids, self.labels, self.vectors, self.low, self.high, self.k, self.same = ids, labels, vectors, low, high, k, same
        self.norm = np.sqrt((vectors**2).sum(axis=1)) * (1 + SLACK)
        shape = (*low.shape, k)
        self.score, self.row_id, self.held = np.full(shape, LEAST), np.zeros(shape, np.int64), np.zeros(low.shape, int)

    def floor(self) -> np.ndarray:
        """The least score per anchor that can still be kept; infinite where no window is open."""
        worst = np.where(self.held == self.k, self.score[:, :, -1], LEAST)
        each = np.where(self.low <= self.high, np.maximum(self.low, worst).astype(float), np.inf)
        return each.min(axis=1, initial=np.inf)

    def full(self, threshold: np.ndarray) -> np.ndarray:
        """Anchors to whose windows no pair below the threshold can add anything."""
        closed = (self.low > self.high) | (self.low >= threshold[:, None])
        return (closed | (self.held == self.k) & (self.score[:, :, -1] >= threshold[:, None])).all(axis=1)

    def feed(self, postings: Postings) -> None:
        step = max(1, PAIRS // max(1, len(postings.ids)))
        for first in range(0, len(self.ids), step):
            self.part(np.arange(first, min(first + step, len(self.ids))), postings)

    def part(self, here: np.ndarray, postings: Postings) -> None:
        """Threshold joins for some anchors, lower and lower until nothing below can be kept."""
        reach = self.norm[here] * postings.rest[:, 0].max(initial=0)
        floor = np.maximum(self.floor()[here], -reach - 1)
        upper = np.where(self.low[here] <= self.high[here], self.high[here].astype(float), -np.inf).max(axis=1, initial=-np.inf)
        upper = np.minimum(upper, reach)
        open_still = floor <= upper
        before = np.full(len(here), np.inf)  # pairs from there on have been looked at
        for start in STARTS:
            here, floor, upper, before = here[open_still], floor[open_still], upper[open_still], before[open_still]
            if not len(here):
                return
            threshold = np.floor(floor + start * (upper - floor))
            lowered = threshold - SLACK * np.abs(threshold)  # whole numbers beyond 2^53 are rounded as floats
            equal = self.labels[here][:, None] == postings.labels[None, :]
            allowed = (equal if self.same else ~equal) & (self.ids[here][:, None] != postings.ids[None, :])
            at, row, score = postings.pairs(self.vectors[here], lowered, allowed)
            new = score < before[at]
            self.keep(here, at[new], postings.ids[row[new]], score[new])
            before, open_still = lowered, ~self.full(here, threshold)

    def full(self, here: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """Anchors to whose windows no pair below the threshold can add anything."""
        low, worst = self.low[here], self.score[here, :, -1]
        closed = (low > self.high[here]) | (low >= threshold[:, None])
        return (closed | (self.held[here] == self.k) & (worst >= threshold[:, None])).all(axis=1)

    def keep(self, here: np.ndarray, at: np.ndarray, row_id: np.ndarray, score: np.ndarray) -> None:
        """The k best of what a window holds and of new pairs, ties by smaller id."""
        anchor = here[at]
        for w in range(self.low.shape[1]):
            inside = (score >= self.low[anchor, w]) & (score <= self.high[anchor, w])
            old_at, old_place = np.nonzero(np.arange(self.k)[None, :] < self.held[here, w, None])
            old = here[old_at]
            who = np.concatenate([old, anchor[inside]])
            what = np.concatenate([self.score[old, w, old_place], score[inside]])
            which = np.concatenate([self.row_id[old, w, old_place], row_id[inside]])
            order = np.lexsort((which, -what, who))
            who, what, which = who[order], what[order], which[order]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            place = np.arange(len(who)) - np.repeat(first, np.diff(first, append=len(who)))
            best = place < self.k
            who, place = who[best], place[best]
            self.held[here, w] = 0
            np.add.at(self.held, (who, w), 1)
            self.score[who, w, place], self.row_id[who, w, place] = what[best], which[best]

    def results(self) -> pa.RecordBatch:
        """A row per anchor and window that holds anything: its rows, best first."""
        at, w = np.nonzero(self.held)
        n = self.held[at, w]
        inside = np.arange(self.k)[None, :] < n[:, None]
        ends = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[at, w][inside], pa.int64())) for x in (self.row_id, self.score)]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at], pa.int64()), pa.array(w, pa.int32()), *lists], FOUND)


FOUND = ["anchor_id", "win", "ids", "scores"]
FOUND_TYPES = "anchor_id long, win int, ids array<long>, scores array<long>"


def _parts(batch: pa.RecordBatch) -> dict[int, tuple]:
    """(ids, labels, vectors, low, high) of a batch's rows, apart by the length of their vectors."""
    vectors = batch.column("vector")
    ends, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    length, ids, labels = np.diff(ends), batch.column("id").to_numpy(), batch.column("label").to_numpy()
    out = {}
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        ends_of = [np.array(batch.column(c).take(pa.array(at)).to_pylist(), np.int64).reshape(len(at), -1) for c in ("low", "high") if batch.column(c).null_count == 0]
        out[int(n)] = (ids[at], labels[at], flat[ends[at][:, None] + np.arange(n)[None, :]].reshape(len(at), n), *ends_of)
    return out


def _tiles(k: int, same: bool):
    """Rows by tile, its anchors first: what each anchor keeps of the tile."""

    def run(batches):
        key, held, tiles = None, {}, None
        for batch in batches:
            blocks = batch.column("anchor_block").to_numpy(), batch.column("row_block").to_numpy()
            change = np.flatnonzero((np.diff(blocks[0]) != 0) | (np.diff(blocks[1]) != 0)) + 1
            for first, last in zip([0, *change], [*change, batch.num_rows]):
                here = blocks[0][first], blocks[1][first]
                if here != key:
                    yield from (t.results() for t in (tiles or {}).values())
                    key, held, tiles = here, {}, None
                part = batch.slice(first, last - first)
                is_anchor = part.column("is_anchor").to_numpy(zero_copy_only=False)
                for n, got in _parts(part.filter(pa.array(is_anchor))).items() if is_anchor.any() else ():
                    held.setdefault(n, []).append(got)
                rest = part.filter(pa.array(~is_anchor))
                if not rest.num_rows or not held:
                    continue
                tiles = tiles or {n: Tile(*(np.concatenate(x) for x in zip(*got)), k, same) for n, got in held.items()}
                for n, got in _parts(rest).items():
                    if n in tiles:
                        tiles[n].feed(Postings(*got[:3]))
        yield from (t.results() for t in (tiles or {}).values())

    return run


def _merged(k: int):
    """The k best of a window from the ordered lists of its tiles."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for anchor, win, lists in zip(*(c.to_pylist() for c in batch.columns)):
                runs = [zip((-s for s in x["scores"]), x["ids"]) for x in lists]
                best = [pair for pair, _ in zip(heapq.merge(*runs), range(k))]
                for values, x in zip(out, (anchor, win, [i for _, i in best], [-s for s, _ in best])):
                    values.append(x)
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], FOUND)

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part; components are scaled and cut to whole numbers."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & whole)
    # floor of a double gives a 64-bit integer; what lies beyond is out by the next condition anyway.
    cut = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(2.0**40)), F.lit(-(2.0**40)))).cast("double"))
    return rows.withColumn("vector", cut).filter(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) < LARGEST)


def _searched(rows: DataFrame, anchors: DataFrame, blocks: int, anchor_blocks: int, k: int, same: bool, name: str) -> DataFrame:
    """(anchor_id, win, ids, scores): the k best rows per anchor and window, from all tiles."""
    turn = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(anchor_blocks)).cast("int")
    place = F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")
    no_ends = F.lit(None).cast("array<long>")
    asked = anchors.select(
        turn.alias("anchor_block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("row_block"), F.lit(True).alias("is_anchor"),
        "id", "label", "vector", "low", "high",
    )
    offered = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("anchor_block"), place.alias("row_block"), F.lit(False).alias("is_anchor"),
        "id", "label", "vector", no_ends.alias("low"), no_ends.alias("high"),
    )
    dealt = asked.unionByName(offered).repartition(F.col("anchor_block"), F.col("row_block"))
    dealt = dealt.sortWithinPartitions("anchor_block", "row_block", F.col("is_anchor").desc())
    found = stored(rows.sparkSession, dealt.mapInArrow(_tiles(k, same), FOUND_TYPES), name)
    lists = found.groupBy("anchor_id", "win").agg(F.collect_list(F.struct("ids", "scores")).alias("lists"))
    return lists.mapInArrow(_merged(k), FOUND_TYPES)


def _windows(n: int) -> list[Column]:
    """low and high: the ends of the windows that ``positive_scores`` set, in whole numbers and
    without products beyond 64 bits. All anchors get n windows; those without a positive are empty."""
    score, each = "get(positive_scores, i)", f"sequence(0, {n - 1})"
    ends = {"low": f"{score} - {score} div 2", "high": f"{score} - ({score} + 19) div 20"}
    return [F.expr(f"transform({each}, i -> coalesce(if({score} >= 0, {end}, null), {none}L))").alias(c) for (c, end), none in zip(ends.items(), (1, 0))]


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    n_positives: int = 5,
    n_negatives: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    anchor_block: int = ANCHOR_BLOCK,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on a row's ``id``. A positive of an anchor is one of the
    ``n_positives`` best other rows of its ``label``; its negatives are the ``n_negatives`` best rows
    of other labels with 50 * positive <= 100 * negative <= 95 * positive. Higher scores come first,
    ties by smaller id. A positive with a negative score, or without rows in its window, gives no row.

    Rows with a null id, label, vector or component, or a component that isn't finite, take no
    part, nor do those whose squared length in whole numbers reaches 2^62, as their scores would
    not be 64-bit integers. Zero and empty vectors take part with scores of zero. Vectors of
    different lengths are not compared. Rows that repeat an id are positives and negatives each on
    their own, but not of an anchor of that id; a repeated anchor is asked once, with the smallest
    of its labels and vectors. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors, id_col, vector_col, label)
    n, n_anchors = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    blocks, anchor_blocks = max(1, -(-n // row_block)), max(1, -(-n_anchors // anchor_block))
    blocks = max(blocks, min(4 * spark.sparkContext.defaultParallelism, -(-n // 512)))  # small inputs: some tiles for each core
    picked = rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*")
    anchors = stored(spark, picked, "anchors")
    all_scores = [F.array(F.lit(x)).alias(c) for c, x in (("low", LEAST), ("high", MOST))]
    best = stored(spark, _searched(rows, anchors.select("*", *all_scores), blocks, anchor_blocks, n_positives, True, "same"), "positives")
    best = best.select(F.col("anchor_id").alias("id"), F.col("ids").alias("positive_ids"), F.col("scores").alias("positive_scores"))
    asked = anchors.join(best, "id").select("id", "label", "vector", *_windows(n_positives))
    found = _searched(rows, stored(spark, asked, "windows"), blocks, anchor_blocks, n_negatives, False, "other")
    out = found.withColumnRenamed("anchor_id", "id").join(best, "id")
    out = out.select(
        F.col("id").alias("anchor_id"), F.get("positive_ids", F.col("win")).alias("positive_id"), F.get("positive_scores", F.col("win")).alias("positive_score"),
        F.posexplode(F.arrays_zip("ids", "scores")).alias("place", "negative"),
    )
    return out.select(
        "anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("negative.ids").alias("negative_id"), "positive_score",
        F.col("negative.scores").alias("negative_score"),
    )
