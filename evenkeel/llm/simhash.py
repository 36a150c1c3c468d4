"""SimHash near copies, found by covering the space of fingerprints with anchors.

The anchors are the words of a covering code: blocks of the 23-bit Golay code (every word is
within 3 bits of exactly one code word) and of the 7-bit Hamming code (within 1 bit). A
fingerprint's home is the anchor that covers it, block by block. It is replicated to every anchor
that it could reach by changing as many bits as two linked fingerprints may differ in: those
within covering radius plus threshold. So of two linked fingerprints each visits the other's
home, and comparing homes with visitors at every anchor finds all links. Of the two meetings one
is enough: a fingerprint visits only anchors up to its own home.

Only different fingerprints are compared, each once, however many copies of a text there are.
At an anchor, links are kept as a forest, so their number grows with the fingerprints, not with
their pairs. An anchor with many homes is split into tiles of a bounded number of homes.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm.components import components
from evenkeel.session import ship_package, stored

BITS, SEED, THRESHOLD = 64, 42, 3
TILE_HOMES = 8192  # homes of an anchor that are compared in one piece
BLOCK = 1 << 16  # shingles that are counted at a time
WORD, CHUNK = 6, 12  # binary logarithms: places of a word of bits, places whose words are kept in one row
# Length, covering radius and parity checks (one per bit) of the two perfect codes.
GOLAY_POLYNOMIAL = 0b101011100011


def _golay_checks() -> list[int]:
    """x^i modulo the generator, for each bit i."""
    out, at = [], 1
    for _ in range(23):
        out.append(at)
        at <<= 1
        if at >> 11:
            at ^= GOLAY_POLYNOMIAL
    return out


KINDS = {"g": (23, 3, _golay_checks()), "h": (7, 1, [1, 2, 3, 4, 5, 6, 7])}
CODES = ["g", "gh", "ghh", "gg", "ggh", "gghh"]  # of 12, 16, 20, 24, 28 and 32 bits of anchor


class Block:
    """One code on some bits: for each syndrome the error patterns by how far they leave the cell."""

    def __init__(self, kind: str, first_bit: int, threshold: int):
        self.length, self.radius, self.checks = KINDS[kind]
        self.first_bit = first_bit
        found: dict[int, list[tuple[int, int]]] = {}
        for weight in range(self.radius + threshold + 1):
            for bits in combinations(range(self.length), weight):
                syndrome = pattern = 0
                for b in bits:
                    syndrome ^= self.checks[b]
                    pattern |= 1 << b
                found.setdefault(syndrome, []).append((max(0, weight - self.radius), pattern))
        size = 1 << max(self.checks).bit_length()
        rows = [sorted(found.get(s, [])) for s in range(size)]
        self.start = np.cumsum([0, *map(len, rows)])[:-1]
        self.excess = np.array([e for r in rows for e, _ in r], np.int64)
        self.pattern = np.array([p for r in rows for _, p in r], np.uint64)
        # Number of patterns of a syndrome with an excess of at most b.
        self.within = np.array([[sum(e <= b for e, _ in r) for b in range(threshold + 1)] for r in rows])
        self.tables = []  # syndromes of eight bits at a time
        for low in range(0, self.length, 8):
            table = np.zeros(256, np.int64)
            for b in range(min(8, self.length - low)):
                table[np.arange(256) >> b & 1 == 1] ^= self.checks[low + b]
            self.tables.append(table)

    def word(self, prints: np.ndarray) -> np.ndarray:
        return prints >> np.uint64(self.first_bit) & np.uint64((1 << self.length) - 1)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for k, table in enumerate(self.tables):
            out ^= table[(words >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)]
        return out


class Cover:
    """The product of blocks: homes, and anchors within covering radius plus threshold."""

    def __init__(self, code: str, threshold: int = THRESHOLD):
        self.threshold, self.blocks, at = threshold, [], 0
        for kind in code:
            self.blocks.append(Block(kind, at, threshold))
            at += self.blocks[-1].length

    def home(self, prints: np.ndarray) -> np.ndarray:
        out = np.zeros(len(prints), np.uint64)
        for b in self.blocks:
            words = b.word(prints)
            out |= (words ^ b.pattern[b.start[b.syndrome(words)]]) << np.uint64(b.first_bit)
        return out

    def visits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the fingerprint, anchor) for every anchor within reach, home included."""
        row = np.arange(len(prints))
        anchor, used = np.zeros(len(prints), np.uint64), np.zeros(len(prints), np.int64)
        for b in self.blocks:
            words = b.word(prints)[row]
            syndrome = b.syndrome(words)
            n = b.within[syndrome, self.threshold - used]
            at = np.repeat(b.start[syndrome] - np.cumsum(n) + n, n) + np.arange(n.sum())
            anchor = np.repeat(anchor, n) | (np.repeat(words, n) ^ b.pattern[at]) << np.uint64(b.first_bit)
            row, used = np.repeat(row, n), np.repeat(used, n) + b.excess[at]
        return row, anchor

    @property
    def replicas(self) -> float:
        """Mean number of visits of a random fingerprint."""
        by_excess = np.array([1.0] + [0.0] * self.threshold)
        for b in self.blocks:
            counts = np.bincount(b.excess, minlength=self.threshold + 1) / len(b.start)
            by_excess = np.convolve(by_excess, counts)[: self.threshold + 1]
        return float(by_excess.sum())

    @property
    def anchors(self) -> int:
        return int(np.prod([1 << b.length for b in self.blocks], dtype=object) // np.prod([len(b.start) for b in self.blocks], dtype=object))


@cache
def cover(code: str, threshold: int = THRESHOLD) -> Cover:
    return Cover(code, threshold)


def best_code(prints: int) -> str:
    """The code of least work for so many fingerprints: a replica costs about as much as 80 comparisons.
    Every code finds the same links."""
    work = {c: cover(c).replicas * (80 + prints / cover(c).anchors) for c in CODES}
    return min(work, key=work.get)


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the word shingles of a text, repeats included; zero for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        counts += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(prints)], names=[*batch.schema.names[1:], "print"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """id, the columns of ``more`` (name=Column) and ``print``: the fingerprint as a signed long. One pass, no shuffle."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *(c.alias(n) for n, c in more.items()))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[1:])
    return narrow.mapInArrow(_fingerprints, f"{types}, print long")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _packed(anchor: np.ndarray, prints: np.ndarray, home: bool):
    """One row per anchor: its fingerprints as a run of bytes."""
    order = np.argsort(anchor, kind="stable")
    anchor, prints = anchor[order], prints[order]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.array([], np.int64)
    ends = np.r_[first[1:], len(anchor)]
    runs = [prints[a:b].tobytes() for a, b in zip(first, ends)]
    return pa.RecordBatch.from_arrays(
        [_signed(anchor[first]), pa.array([home] * len(runs), pa.bool_()), pa.array(runs, pa.binary())],
        ["anchor", "home", "prints"],
    )


def _dealt(code: str, most: int):
    """Homes and visits of the fingerprints of a partition, packed per anchor."""

    def run(batches):
        c = cover(code)
        for batch in batches:
            everything = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(everything), most):
                prints = everything[at : at + most]
                home = c.home(prints)
                yield _packed(home, prints, True)
                row, anchor = c.visits(prints)
                early = anchor <= home[row]
                yield _packed(anchor[early], prints[row[early]], False)

    return run


def _tiled(batches):
    """Packed rows with their number of tiles: a home goes to the tile of its hash, a visitor to all."""
    for batch in batches:
        out = [[], [], [], []]
        for anchor, home, run, tiles in zip(*(c.to_pylist() for c in batch.columns)):
            prints = np.frombuffer(run, np.uint64)
            tile_of = (prints * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(tiles)
            for tile in range(tiles):
                part = prints[tile_of == tile] if home and tiles > 1 else prints
                if len(part):
                    for values, x in zip(out, (anchor, tile, not home, part.tobytes())):
                        values.append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.binary())],
            ["anchor", "tile", "visitor", "prints"],
        )


class Forest:
    """Links among the homes of one tile and its visitors, without those that close a circle."""

    def __init__(self, homes: np.ndarray, threshold: int):
        self.homes, self.threshold = homes, threshold
        self.label = np.arange(len(homes))  # homes known to be connected have one label

    def links(self, visitors: np.ndarray):
        """New links (a, b): each visitor with one home of every group that it touches."""
        step = max(1, (1 << 20) // max(1, len(self.homes)))
        for at in range(0, len(visitors), step):
            part = visitors[at : at + step]
            near = np.bitwise_count(part[:, None] ^ self.homes[None, :]) <= self.threshold
            row, col = np.nonzero(near)
            if not len(row):
                continue
            touched = np.unique(row * len(self.homes) + self.label[col])
            row, group = np.divmod(touched, len(self.homes))
            joined = self.join(row, group)
            other = part[row] != self.homes[group]
            yield part[row[other & joined]], self.homes[group[other & joined]]

    def join(self, row: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Join the groups that one visitor touches; which of its links say something new."""
        new = np.ones(len(row), bool)
        parent: dict[int, int] = {}

        def root(g):
            while (up := parent.get(g, g)) != g:
                g = up
            return g

        same = np.r_[False, row[1:] == row[:-1]]
        if same.any():
            first = -1
            for k, (g, again) in enumerate(zip(group.tolist(), same.tolist())):
                r = root(g)
                if not again:
                    first = r
                elif r == first:
                    new[k] = False
                else:
                    low, high = sorted((first, r))
                    parent[high] = low
                    first = low
            roots = np.array([root(g) for g in range(len(self.homes))]) if parent else None
            if roots is not None:
                self.label = roots[self.label]
        return new


def _compared(threshold: int):
    """Rows by anchor, tile and homes first: links between homes and visitors of each tile."""

    def run(batches):
        key, homes, forest = None, [], None
        for batch in batches:
            a_s, b_s = [], []
            for anchor, tile, visitor, prints in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (anchor, tile):
                    key, homes, forest = (anchor, tile), [], None
                prints = np.frombuffer(prints, np.uint64)
                if not visitor:
                    homes.append(prints)
                elif homes:
                    forest = forest or Forest(np.concatenate(homes), threshold)
                    for a, b in forest.links(prints):
                        a_s.append(a)
                        b_s.append(b)
            none = np.array([], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [_signed(np.concatenate([none, *a_s])), _signed(np.concatenate([none, *b_s]))], ["a", "b"]
            )

    return run


def links(prints: DataFrame, code: str | None = None, tile_homes: int = TILE_HOMES, most: int = 1 << 14) -> DataFrame:
    """(a, b): links between different fingerprints (column ``print``, distinct longs) that
    connect everything within THRESHOLD bits; of links that close a circle not all are given."""
    spark = prints.sparkSession
    ship_package(spark)
    code = code or best_code(prints.count())
    packed = stored(spark, prints.mapInArrow(_dealt(code, most), "anchor long, home boolean, prints binary"), "anchors")
    homes = packed.filter("home").groupBy("anchor").agg(F.sum(F.length("prints") / 8).alias("homes"))
    wide = homes.filter(F.col("homes") > tile_homes).select("anchor", F.ceil(F.col("homes") / tile_homes).cast("int").alias("tiles"))
    tiled = packed.join(wide, "anchor", "left").select("anchor", "home", "prints", F.coalesce("tiles", F.lit(1)))
    rows = tiled.mapInArrow(_tiled, "anchor long, tile int, visitor boolean, prints binary")
    dealt = rows.repartition("anchor", "tile").sortWithinPartitions("anchor", "tile", "visitor")
    return dealt.mapInArrow(_compared(THRESHOLD), "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """id, the columns of ``more``, ``print`` (signed long) and ``component_id``: the smallest id
    that can be reached over links of at most THRESHOLD bits, itself included.

    One row per row of ``docs``. Null and empty texts have fingerprint zero and link like any
    other. Rows with a null id take part; the component id is the smallest id that is not null.
    """
    spark = docs.sparkSession
    found = stored(spark, fingerprints(docs, id_col, text_col, **more), "prints")
    classes = stored(spark, found.groupBy("print").agg(F.min("id").alias("least")), "classes")
    roots = components(links(classes.select("print")))
    rooted = classes.join(roots, classes["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    rooted = stored(spark, rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(spark, rooted.join(least, "root").select("print", "component_id"), "labels")
    return found.join(labels, "print").select(F.col("id").alias(id_col), *more, "print", "component_id")


def _place(docs: DataFrame) -> Column | None:
    """File and place in it of every row, None if the rows don't come from Parquet files."""
    try:
        found = docs.metadataColumn("_metadata")
        place = F.struct(found["file_path"].alias("file"), found["row_index"].alias("at"))
        docs.select(place)
    except AnalysisException:
        return None
    return place


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", written: bool = False) -> DataFrame:
    """``docs`` with one row of each component: the row of its smallest id, null ids last; of several
    such rows the first. Columns may have any name and type: rows are packed beside a number of
    their own, and whole rows are never compared.

    The numbers have to be the same when the rows are read again, so the packed rows are written
    once. ``written`` says that ``docs`` is read straight from Parquet files: there a row is known
    by its file and its place in it, however the files are dealt to tasks. Where rows have no such
    place after all, they are written.

    Which rows are chosen is kept as a bit per row, packed by file and CHUNK of places: so small
    that Spark broadcasts it for millions of rows, and the rows with their texts are not shuffled.
    """
    spark = docs.sparkSession
    place = _place(docs) if written else None
    number = F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at")) if place is None else place
    numbered = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), number.alias("number")
    )
    if place is None:
        numbered = stored(spark, numbered, "numbered")
    found = near_copies(numbered.select("number", "text", "id"), "number", "text", row_id=F.col("id"))
    best = F.min(F.struct(F.col("row_id").isNull().alias("no_id"), "row_id", "number")).alias("best")
    chosen = found.groupBy("component_id").agg(best).select("best.number.*")
    word, bit = F.shiftright("at", WORD).alias("word"), F.col("at").bitwiseAND((1 << WORD) - 1).cast("int").alias("bit")
    words = chosen.select("file", word, bit).groupBy("file", "word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), "bit")).alias("bits"))
    chunk = F.shiftright("word", CHUNK - WORD).alias("chunk")
    kept = words.groupBy("file", chunk).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("kept"))
    kept = stored(spark, kept, "chosen")
    rows = numbered.select("row", "number.*").select("row", "file", word, bit).withColumn("chunk", chunk)
    return rows.join(kept, ["file", "chunk"]).filter(F.getbit(F.col("kept")[F.col("word")], F.col("bit")) == 1).select("row.*")
