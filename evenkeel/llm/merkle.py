"""Merkle manifest of a table: one tree per group of rows, one over the groups, proofs for every row.

Leaves are digests of rows; every three consecutive nodes become their parent (the last run of a
level may be shorter, a lone node there is hashed again), until one node remains. H is the
lowercase hexadecimal SHA-256 of its inputs put together, digests as text.

The tree is written as a log in completion order: a node follows its children at once. The leaves
are dealt to aligned builders, each of which has 3 ** HEIGHT consecutive leaves of one tree and
therefore writes whole subtrees; their top nodes are the leaves of the next tier of builders, so
a tree of any size needs a few tiers and no task sees more than one builder's share at a time.
Within a builder's piece of the log every node stands at a place that follows from the sizes of
the subtrees before it (``position``), so proofs are read from the log by arithmetic alone:
nothing is searched for, and no links between nodes are stored.

Rows are numbered without a window over a whole tree: they are dealt to ranges of (tree, key),
numbered within their range, and get the number of rows in the ranges before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evenkeel.session import ship_package, stored

ARITY = 3
HEIGHT = 7  # a builder has ARITY ** HEIGHT leaves
RANGE_ROWS = 250_000  # leaves that are numbered in one task
DIGEST = 32
WHOLE = "whole"  # the name of the tree over the groups

PIECE = "tree string, block long, nodes long, log binary, item_list array<{item}>"
STEPS = "places array<int>, sizes array<int>, siblings binary"


def h(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def climb(n: int) -> int:
    """Levels above n leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def subtree(leaves: int, level: int) -> int:
    """Nodes of a subtree whose top is on ``level`` and that has that many leaves."""
    return sum(-(-leaves // ARITY**i) for i in range(level + 1))


def position(level: int, index: int, leaves: int, top: int) -> int:
    """Place of a node in the log, in completion order, of a tree with ``top`` levels over its
    leaves: all nodes that end before its first leaf, then its own subtree, of which it is the last."""
    first = index * ARITY**level
    own = min(leaves, first + ARITY**level) - first
    return sum(first // ARITY**i for i in range(top + 1)) + subtree(own, level) - 1


def completion_log(leaves: list[str], top: int) -> list[str]:
    """The nodes of a tree with ``top`` levels over its leaves, each appended when it is complete."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(top + 1)]

    def complete(level: int, digest: str) -> None:
        log.append(digest)
        run = open_runs[level]
        run.append(digest)
        if len(run) == ARITY and level < top:
            open_runs[level] = []
            complete(level + 1, h(*run))

    for leaf in leaves:
        complete(0, leaf)
    for level in range(top):  # the runs at the right edge, shorter than the others
        if run := open_runs[level]:
            open_runs[level] = []
            complete(level + 1, h(*run))
    return log


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(*values: Column) -> Column:
    """H of the values, each as ``field`` writes it."""
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


def tree_name(group: Column) -> Column:
    """A text that orders and tells apart groups as their UTF-8 bytes do, null before all others."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _numbered(batches):
    """Sorted rows with their range (``part``) and their number within range and tree."""
    part, tree, number = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        trees, numbers = batch.column("tree").to_pylist(), []
        for name in trees:
            tree, number = name, number + 1 if name == tree else 0
            numbers.append(number)
        extra = [pa.array([part] * len(numbers), pa.int64()), pa.array(numbers, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "number"])


def indexed(rows: DataFrame, *order: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` (tree, digest, item, the columns of ``order``) as (tree, leaf_index, leaves, digest, item).

    Within a tree leaves ascend by ``order`` (nulls first), then by digest; rows that are equal in
    both may stand either way. Rows that are equal in everything are dealt out like all others.
    """
    spark = rows.sparkSession
    ship_package(spark)
    rows = stored(spark, rows.withColumn("turn", F.monotonically_increasing_id()), "leaves")
    by = ["tree", *order, "digest", "turn"]
    ranges = max(1, -(-rows.count() // range_rows), min(rows.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism))
    dealt = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    kept = [*dealt.schema.fields]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", part long, number long"
    dealt = stored(spark, dealt.mapInArrow(_numbered, kinds), "numbered")
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy("tree").orderBy("part")
    counts = counts.select(
        "tree", "part", (F.sum("here").over(earlier) - F.col("here")).alias("before"), F.sum("here").over(Window.partitionBy("tree")).alias("leaves")
    )
    joined = dealt.join(stored(spark, counts, "ranges"), ["tree", "part"])
    return joined.select("tree", (F.col("before") + F.col("number")).alias("leaf_index"), "leaves", "digest", "item")


def _groups(batches) -> Iterator[tuple]:
    """(key, rows) of each (tree, block) from rows that are sorted by it; a group may span batches."""
    key, parts = None, []
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist()))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != key and parts:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = keys[at]
            parts.append(batch.slice(at, end - at))
            at = end
    if parts:
        yield key, pa.Table.from_batches(parts)


def _top(nodes: int, height: int) -> int:
    """Levels that a builder climbs in a tree that has so many nodes on the builder's lowest level."""
    return height if nodes > ARITY**height else climb(nodes)


def _builder(height: int):
    def run(batches):
        for (tree, block), rows in _groups(batches):
            nodes = rows.column("nodes")[0].as_py()
            log = completion_log(rows.column("digest").to_pylist(), _top(nodes, height))
            items = rows.column("item").combine_chunks()
            items = items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([tree]), pa.array([block], pa.int64()), pa.array([nodes], pa.int64()),
                    pa.array([bytes.fromhex("".join(log))], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items),
                ],
                ["tree", "block", "nodes", "log", "item_list"],
            )

    return run


def grow(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The log of all trees over ``leaves`` (see ``indexed``), as a table of pieces per tier of builders.

    A piece has tree, block (the builder's number), nodes (of the whole tree on the tier's lowest
    level), log (the digests in completion order, 32 bytes each) and item_list (of its leaves).
    """
    spark = leaves.sparkSession
    ship_package(spark)
    share = ARITY**height
    rows = leaves.select("tree", "leaf_index", F.col("leaves").alias("nodes"), "digest", "item")
    tiers: list[DataFrame] = []
    while True:
        item = rows.schema["item"].dataType.simpleString()
        placed = rows.withColumn("block", F.floor(F.col("leaf_index") / share).cast("long"))
        dealt = placed.repartition("tree", "block").sortWithinPartitions("tree", "block", "leaf_index")
        pieces = stored(spark, dealt.mapInArrow(_builder(height), PIECE.format(item=item)), f"log{len(tiers)}")
        tiers.append(pieces)
        more = pieces.filter(F.col("nodes") > share)
        if more.isEmpty():
            return tiers
        rows = more.select(
            "tree", F.col("block").alias("leaf_index"), F.ceil(F.col("nodes") / share).cast("long").alias("nodes"),
            F.lower(F.hex(F.col("log").substr(F.length("log") - DIGEST + 1, F.lit(DIGEST)))).alias("digest"), F.lit(None).cast("int").alias("item"),
        )


def roots(tiers: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """(tree, digest) of the top node of every tree."""
    last = F.lower(F.hex(F.col("log").substr(F.length("log") - DIGEST + 1, F.lit(DIGEST))))
    found = [t.filter(F.col("nodes") <= ARITY**height).select("tree", last.alias("digest")) for t in tiers]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def steps_of(log: bytes, leaves: int, index: int, top: int) -> tuple[list[int], list[int], bytes]:
    """The way from a leaf to the top of a piece: its place in each run, the sizes of the runs, and
    the digests of the others in them, read from where ``position`` says that they stand."""
    places, sizes, siblings = [], [], []
    on_level = leaves
    for level in range(top):
        first = index - index % ARITY
        run = range(first, min(first + ARITY, on_level))
        places.append(index - first)
        sizes.append(len(run))
        for other in run:
            if other != index:
                at = position(level, other, leaves, top) * DIGEST
                siblings.append(log[at : at + DIGEST])
        index, on_level = index // ARITY, -(-on_level // ARITY)
    return places, sizes, b"".join(siblings)


def _prover(height: int):
    share = ARITY**height

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "nodes", "log", "places", "sizes", "siblings", "root", "subroot")))
            for number, (tree, block, nodes, log, places, sizes, siblings, root, subroot) in enumerate(rows):
                items = batch.column("item_list")[number].values
                leaves, top = min(share, nodes - block * share), _top(nodes, height)
                ways = [steps_of(log, leaves, i, top) for i in range(leaves)]
                at = [position(0, i, leaves, top) * DIGEST for i in range(leaves)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree] * leaves), pa.array(range(block * share, block * share + leaves), pa.int64()),
                        pa.array([log[a : a + DIGEST].hex() for a in at]), items,
                        pa.array([p + places for p, _, _ in ways], pa.list_(pa.int32())),
                        pa.array([s + sizes for _, s, _ in ways], pa.list_(pa.int32())),
                        pa.array([x + siblings for _, _, x in ways], pa.binary()),
                        pa.array([root] * leaves), pa.array([subroot] * leaves),
                    ],
                    ["tree", "leaf_index", "digest", "item", "places", "sizes", "siblings", "root", "subroot"],
                )

    return run


def proofs(tiers: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row per leaf: tree, leaf_index, digest, item, places, sizes, siblings, root, subroot.

    ``above`` has one row per tree: its name, the way from its top on (places, sizes, siblings;
    empty if it is the whole), root and subroot. Tiers are gone through from the top: what a
    builder's top node needs is the tail of every way in its piece.
    """
    spark = tiers[0].sparkSession
    ship_package(spark)
    tail = ["places", "sizes", "siblings", "root", "subroot"]
    found: DataFrame | None = None
    for number, pieces in reversed(list(enumerate(tiers))):
        ends = pieces.filter(F.col("nodes") <= ARITY**height).select("tree", "block").join(above, "tree").select("tree", "block", *tail)
        if found is not None:
            ends = ends.unionByName(found.select("tree", F.col("leaf_index").alias("block"), *tail))
        item = pieces.schema["item_list"].dataType.elementType.simpleString()
        kinds = f"tree string, leaf_index long, digest string, item {item}, {STEPS}, root string, subroot string"
        found = pieces.join(stored(spark, ends, f"tails{number}"), ["tree", "block"]).mapInArrow(_prover(height), kinds)
    return found


def fold(leaf: str, places: list[int], sizes: list[int], siblings: bytes) -> str:
    """The top digest that follows from a leaf and its way."""
    text, at, digest = siblings.hex(), 0, leaf
    for place, size in zip(places, sizes):
        middle, end = at + place * 2 * DIGEST, at + (size - 1) * 2 * DIGEST
        digest = hashlib.sha256((text[at:middle] + digest + text[middle:end]).encode()).hexdigest()
        at = end
    return digest


def _folder(batches):
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("leaf_now", "places", "sizes", "siblings"))
        folded = pa.array([fold(*row) for row in zip(*columns)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, folded], [*batch.schema.names, "folded_root"])


def folded(ways: DataFrame, leaf_now: Column) -> DataFrame:
    """``ways`` (see ``proofs``) with leaf_now, folded_root and verified: whether the leaf as it is
    now still leads to the root."""
    rows = ways.withColumn("leaf_now", leaf_now)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", folded_root string"
    return rows.mapInArrow(_folder, kinds).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(rows: DataFrame, *order: str, height: int = HEIGHT) -> DataFrame:
    """The proofs (see ``proofs``) of ``rows`` (tree, digest, item and the columns of ``order``),
    from each row over the top of its tree (``subroot``) to the top of the tree over all (``root``).

    Trees stand in the order of their names. An empty table gives no rows.
    """
    spark = rows.sparkSession
    tiers = grow(indexed(rows, *order), height)
    tops = stored(spark, roots(tiers, height), "subroots")
    upper = grow(indexed(tops.select(F.lit(WHOLE).alias("tree"), "digest", F.struct("tree").alias("item"), F.col("tree").alias("place")), "place"), height)
    root = roots(upper, height)
    nothing = [F.array().cast("array<int>").alias("places"), F.array().cast("array<int>").alias("sizes"), F.lit(b"").alias("siblings")]
    start = root.select("tree", *nothing, F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"))
    above = proofs(upper, start, height).select(
        F.col("item.tree").alias("tree"), "places", "sizes", "siblings", "root", F.col("digest").alias("subroot")
    )
    return proofs(tiers, stored(spark, above, "above"), height)


def tampered_rows(doc_id: Column) -> Column:
    """The rows that the audit tampers with: 2 divides the CRC-32 of the id as decimal text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def audited(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, siblings, folded_root, verified for every row of ``docs``
    (doc_id, source, lang, n_chars, text; all others are ignored).

    A tree per source: null before all others, and apart from the empty text. Null ids come first
    in theirs and are not tampered with; rows of one id stand by their digests, and repeated rows
    are leaves of their own, each with its own proof. Null fields are written as ``-``, so a null
    and an empty text differ. Texts of any length are hashed by Spark's own functions; only
    digests go on from there. An empty table gives no rows.
    """
    def leaf(text: Column) -> Column:
        return digest_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    text = F.col("text")
    changed = tampered_rows(F.col("doc_id")) & text.contains("\n")
    rows = docs.select(
        tree_name(F.col("source")).alias("tree"), "doc_id", leaf(text).alias("digest"),
        F.struct("doc_id", F.when(changed, leaf(F.translate(text, "\n", ""))).alias("changed")).alias("item"),
    )
    ways = manifest(rows, "doc_id", height=height)
    return folded(ways, F.coalesce("item.changed", "digest")).select(
        F.col("item.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "siblings", "folded_root", "verified"
    )
