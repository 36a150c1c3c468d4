"""The Merkle manifest against a plain version, its closed forms, odd rows, and the query against its SQL."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from oracle import database, differences
from pyspark.sql import functions as F

from evenkeel.llm import merkle, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, i):
    steps = []
    for nodes in tree[:-1]:
        run = nodes[i - i % 3 : i - i % 3 + 3]
        steps.append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
        i //= 3
    return steps


def brute_force(rows):
    """(doc_id, leaf, subroot, root, siblings, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in members[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for place, s in enumerate(sources):
        for i, row in enumerate(members[s]):
            steps = way(trees[s], i) + way(top, place)
            now = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                now = (*row[:4], row[4].replace("\n", ""))
            digest = leaf(now)
            for at, others in steps:
                digest = sha("".join(others[:at] + [digest] + others[at:]))
            siblings = "".join(d for _, others in steps for d in others)
            out.append((row[0], leaf(row), trees[s][-1][0], top[-1][0], siblings, digest, digest == top[-1][0]))
    return sorted(out, key=repr)


def audited(df, height):
    found = merkle.audited(df, height).withColumn("siblings", F.lower(F.hex("siblings")))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_query_agrees_with_its_sql(spark):
    assert differences(queries.op11_merkle(spark, SF), database(SF), queries.SQL["op11_merkle"]) == []


@pytest.mark.parametrize("height", [1, 2, 7])
def test_odd_rows(spark, height):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "ü"]), "en", i, rng.choice(["", "x", "one\ntwo", "\n" * 5, None])) for i in range(70)]
    rows += [(None, "a", None, None, "no id\n"), (None, None, None, None, None), (5, None, "en", 1, "\n"), (6, "", "en", 1, "x\ny")]
    rows += [(7, "c", "en", 1, "same\n")] * 4 + [(7, "c", "en", 1, "other")]  # one id, four rows alike
    rows += [(900, "long", "en", 3, "word\n" * 400_000)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    df = df.withColumn("tree", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("item", F.lit(2)).withColumn("root", F.lit(0))
    assert audited(df, height) == brute_force(rows)


def test_one_source_and_one_row(spark):
    rows = [(i, "a", "en", 1, f"{i}\n") for i in range(4)]
    assert audited(spark.createDataFrame(rows, DOCS), 1) == brute_force(rows)
    assert audited(spark.createDataFrame(rows[:1], DOCS), 1) == brute_force(rows[:1])


def test_empty_table(spark):
    found = merkle.audited(spark.createDataFrame([], DOCS))
    assert found.count() == 0 and found.columns == ["doc_id", "leaf", "subroot", "root", "siblings", "folded_root", "verified"]


def test_damage_is_found(spark):
    """Any other change of a leaf or of a sibling leads elsewhere."""
    rows = levels([sha(str(i)) for i in range(20)])
    log = bytes.fromhex("".join(merkle.completion_log(rows[0], merkle.climb(20))))
    places, sizes, siblings = merkle.steps_of(log, 20, 11, merkle.climb(20))
    assert merkle.fold(rows[0][11], places, sizes, siblings) == rows[-1][0]
    assert merkle.fold(sha("else"), places, sizes, siblings) != rows[-1][0]
    assert merkle.fold(rows[0][11], places, sizes, bytes([siblings[0] ^ 1]) + siblings[1:]) != rows[-1][0]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2))
def test_closed_positions(n, extra):
    """Every node stands in the log where the closed form says, also in a piece that climbs further."""
    top = merkle.climb(n) + extra
    tree = [[sha(str(i)) for i in range(n)]]
    for _ in range(top):
        tree.append([sha("".join(tree[-1][i : i + 3])) for i in range(0, len(tree[-1]), 3)])
    log = merkle.completion_log(tree[0], top)
    assert len(log) == merkle.subtree(n, top) == sum(map(len, tree))
    for level, nodes in enumerate(tree):
        for i, digest in enumerate(nodes):
            assert log[merkle.position(level, i, n, top)] == digest
