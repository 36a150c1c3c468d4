"""Nearest neighbours by a block matrix join with quantised products and exact results.

Queries and candidates are cut into blocks; every pair of blocks is a tile, and Spark deals tiles
to tasks. In a tile each vector is a scale times 8-bit integers, with the length of what rounding
took away. The products of the integers are exact (a matrix product whose sums stay below 2^24 in
single, else 2^53 in double precision), so the distance of two vectors is known to within the sum
of their two rounding lengths. A candidate whose lower bound is above the k-th smallest upper
bound of a query is out; the rest are computed again from the original vectors in double
precision. Each tile gives every query its k nearest; heaps merge those.

Nothing is approximate: the bounds only save work.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.session import ship_package, stored

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 1 << 19  # candidates are streamed, queries are held
PAIRS = 1 << 20  # pairs of a tile that are worked on at a time
SLACK = 1e-7  # relative room for the rounding of the bounds themselves: above the root of double precision


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(integers, scale, rounding length) of the rows of x: row = scale * integers + rest."""
    scale = np.abs(x).max(axis=1) / 127
    integers = np.rint(x / scale[:, None]).astype(np.int8)
    rest = np.sqrt(((x - scale[:, None] * integers) ** 2).sum(axis=1))
    return integers, scale, rest


def exact(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows; the squares are added up from left to right."""
    d = queries - candidates
    return np.sqrt(np.add.accumulate(d * d, axis=1)[:, -1])


class Tile:
    """The k nearest candidates of each query of a block, fed with candidates piece by piece."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        with np.errstate(all="ignore"):
            self.integers, self.scale, self.rest = quantised(vectors)
            self.squares = self.scale**2 * (self.integers.astype(np.int64) ** 2).sum(axis=1)
        self.kind = np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]  # heaps with the worst on top
        self.bound = np.full(len(ids), np.inf)  # no candidate beyond it is among the k nearest

    def feed(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        with np.errstate(all="ignore"):  # components may be too large or too small for their squares
            integers, scale, rest = quantised(vectors)
            self._feed(ids, vectors, integers, scale, rest)

    def _feed(self, ids: np.ndarray, vectors: np.ndarray, integers: np.ndarray, scale: np.ndarray, rest: np.ndarray) -> None:
        product = (self.integers.astype(self.kind) @ integers.astype(self.kind).T).astype(np.float64)
        squares = scale**2 * (integers.astype(np.int64) ** 2).sum(axis=1)
        apart = self.squares[:, None] + squares[None, :] - 2 * self.scale[:, None] * scale[None, :] * product
        middle = np.sqrt(np.maximum(apart, 0))
        error = self.rest[:, None] + rest[None, :]
        room = SLACK * np.sqrt(self.squares[:, None] + squares[None, :]) + np.finfo(float).tiny
        other = self.ids[:, None] != ids[None, :]
        # A bound that overflows says nothing: the pair is computed again.
        upper, lower = middle + error + room, middle - error - room
        upper = np.where(other & np.isfinite(upper), upper, np.inf)
        lower = np.where(np.isfinite(lower), lower, -np.inf)
        if upper.shape[1] >= self.k:
            near = np.partition(upper, self.k - 1, axis=1)[:, self.k - 1]
            self.bound = np.minimum(self.bound, near)
        row, col = np.nonzero(other & (lower <= self.bound[:, None]))
        for at in range(0, len(row), 1 << 16):
            r, c = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
            for q, i, d in zip(r.tolist(), ids[c].tolist(), exact(self.vectors[r], vectors[c]).tolist()):
                heap = self.best[q]
                if len(heap) < self.k:
                    heapq.heappush(heap, (-d, -i))
                elif (-d, -i) > heap[0]:
                    heapq.heapreplace(heap, (-d, -i))
        full = [q for q, heap in enumerate(self.best) if len(heap) == self.k]
        self.bound[full] = np.minimum(self.bound[full], [-self.best[q][0][0] for q in full])

    def results(self) -> pa.RecordBatch:
        """A row per query that has candidates: ids and distances, nearest first."""
        found = [(q, sorted((-d, -i) for d, i in heap)) for q, heap in zip(self.ids.tolist(), self.best) if heap]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([q for q, _ in found], pa.int64()),
                pa.array([[i for _, i in best] for _, best in found], pa.list_(pa.int64())),
                pa.array([[d for d, _ in best] for _, best in found], pa.list_(pa.float64())),
            ],
            ["query_id", "ids", "distances"],
        )


def _rows(batch) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids and vectors of a batch, apart by their length."""
    ids, vectors = batch.column("id").to_numpy(), batch.column("vector")
    length = np.diff(vectors.offsets.to_numpy())
    flat, start = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()[:-1]
    out = {}
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        out[int(n)] = ids[at], flat[start[at][:, None] + np.arange(n)[None, :]]
    return out


def _tiles(k: int):
    """Rows by tile, its queries first: the k nearest of each query in the tile."""

    def run(batches):
        key, queries, tiles = None, {}, None
        for batch in batches:
            query_tile = batch.column("query_block").to_numpy(), batch.column("candidate_block").to_numpy()
            change = np.flatnonzero((np.diff(query_tile[0]) != 0) | (np.diff(query_tile[1]) != 0)) + 1
            for first, last in zip([0, *change], [*change, batch.num_rows]):
                here = query_tile[0][first], query_tile[1][first]
                if here != key:
                    if tiles:
                        yield from (t.results() for t in tiles.values())
                    key, queries, tiles = here, {}, None
                part = batch.slice(first, last - first)
                is_query = part.column("is_query").to_numpy(zero_copy_only=False)
                for n, (ids, vectors) in _rows(part.filter(pa.array(is_query))).items() if is_query.any() else ():
                    queries.setdefault(n, []).append((ids, vectors))
                rest = part.filter(pa.array(~is_query))
                if not rest.num_rows or not queries:
                    continue
                tiles = tiles or {n: Tile(*(np.concatenate(x) for x in zip(*got)), k) for n, got in queries.items()}
                for n, (ids, vectors) in _rows(rest).items():
                    step = max(1, PAIRS // len(tiles[n].ids)) if n in tiles else 1
                    for at in range(0, len(ids) if n in tiles else 0, step):
                        tiles[n].feed(ids[at : at + step], vectors[at : at + step])
        if tiles:
            yield from (t.results() for t in tiles.values())

    return run


def _merged(k: int):
    """The k nearest of a query from the ordered lists of its tiles."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for query, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs = [list(zip(x["distances"], x["ids"])) for x in lists]
                best = heapq.nsmallest(k, heapq.merge(*runs)) if len(runs) > 1 else runs[0]
                for rank, (d, i) in enumerate(best, 1):
                    for values, x in zip(out, (query, rank, i, d)):
                        values.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["query_id", "rank", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part: those with an id and a vector that is not null,
    empty or zero and holds no null or non-finite component."""
    v = F.col("vector")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists(v, lambda x: x != 0)
    )


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` (a condition on its ``id``)
    the k nearest other rows by Euclidean distance, ties to the smaller id.

    Distances that overflow are infinite, like the same sum in Spark; they rank last, by id. Rows that
    don't take part (see ``usable``) are neither queries nor candidates. Vectors of
    different lengths are not compared. Rows that repeat an id are candidates each on their own,
    but not of a query of that id; a repeated query is asked once, with the
    smallest of its vectors.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors, id_col, vector_col)
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, query_blocks = max(1, -(-n // candidate_block)), max(1, -(-n_queries // query_block))
    blocks = max(blocks, min(4 * spark.sparkContext.defaultParallelism, -(-n // 512)))  # small inputs: some tiles for each core
    place = F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")
    turn = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int")
    queries = rows.filter(is_query).groupBy("id").agg(F.min("vector").alias("vector")).select(
        turn.alias("query_block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("candidate_block"), F.lit(True).alias("is_query"), "id", "vector"
    )
    candidates = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"), place.alias("candidate_block"), F.lit(False).alias("is_query"), "id", "vector"
    )
    dealt = (
        queries.unionByName(candidates)
        .repartition(F.col("query_block"), F.col("candidate_block"))
        .sortWithinPartitions("query_block", "candidate_block", F.col("is_query").desc())
    )
    found = stored(spark, dealt.mapInArrow(_tiles(k), "query_id long, ids array<long>, distances array<double>"), "tiles")
    lists = found.groupBy("query_id").agg(F.collect_list(F.struct("ids", "distances")).alias("lists"))
    return lists.mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")
