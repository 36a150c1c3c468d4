"""SimHash against brute force: every pair compared, components by search."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evenkeel.llm import queries, simhash
from evenkeel.llm.components import _towards_least, components

SF = "/root/testdata/sf0.001"


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Root (smallest position) of each print."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("code", simhash.CODES)
def test_linked_prints_meet_at_a_home(code):
    rng, cover = random.Random(1), simhash.cover(code)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        pair = np.array([x, y], np.uint64)
        home = cover.home(pair)
        row, anchor = cover.visits(pair)
        seen = {(r, a) for r, a in zip(row.tolist(), anchor.tolist())}
        assert len(seen) == len(row)
        assert {(0, int(home[1])), (1, int(home[0])), (0, int(home[0]))} <= seen


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(5)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("code, tile", [("g", 8192), ("g", 20), ("ghh", 8192), ("gg", 7)])
def test_links_connect_what_is_near(spark, code, tile):
    prints = clustered(700, 3)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "print long").repartition(3)
    found = {r.node: r.root for r in components(simhash.links(df, code, tile)).collect()}
    mine, groups = [found.get(x, x) for x in signed], plain_components(prints)
    assert len(set(zip(mine, groups))) == len(set(mine)) == len(set(groups))


def test_links_are_few_in_a_dense_group(spark):
    prints = [(1 << a | 1 << b | 1 << c) for a in range(20) for b in range(20) for c in range(20)]
    df = spark.createDataFrame([(x,) for x in set(prints)], "print long")
    assert simhash.links(df, "g").count() < 40 * len(set(prints))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 200), (200, 300), (None, 3)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 61)} | {k: 100 for k in range(101, 140)} | {300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = [plain_print(t) for _, t in docs]
    roots = plain_components(prints)
    want = {d: (f"{p:016x}", docs[r][0]) for (d, _), p, r in zip(docs, prints, roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == want
    assert len(set(roots)) < len(roots)


def test_edges(spark):
    rows = [(5, None, 1), (4, "", 2), (None, " \n", 3), (7, "One", 4), (7, "one", 5), (8, "x " * 300_000, 6), (9, "two words", 7), (9, "two words", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print long")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_copies(docs).collect()), key=repr)
    assert got == sorted([(5, 4), (4, 4), (None, 4), (7, 7), (7, 7), (8, 8), (9, 9), (9, 9)], key=repr)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 7, 8, 9]
    assert simhash.near_copies(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_takes_any_columns(spark):
    """Names that are used inside, maps, rows that are equal, ids that are null."""
    text, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(3, text, {"k": "a"}, 1.0, 1, "x"), (2, text, {"k": "b"}, 2.0, 2, "y"), (2, text, {"k": "b"}, 2.0, 2, "y")]
    rows += [(None, other, None, 3.0, 3, "z"), (None, other, None, 3.0, 3, "z"), (None, None, {}, 4.0, 4, None)]
    names = "doc_id long, text string, m map<string,string>, _mark double, _rows int, number string"
    docs = spark.createDataFrame(rows, names).withColumns({"row": F.lit(1), "_id": F.lit(2), "_chosen": F.lit(3), "id": F.lit(4)})
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.m, r._mark) for r in kept.collect()), key=repr) == sorted(
        [(2, text, {"k": "b"}, 2.0), (None, other, None, 3.0), (None, None, {}, 4.0)], key=repr
    )


def test_one_of_each_of_a_written_table_does_not_depend_on_how_it_is_dealt_to_tasks(spark, tmp_path):
    """The files are read several times, and cut otherwise when executors come or go in between."""
    texts = [f"{chr(97 + n % 26) * 3} {n} words of a text that is like no other {n * 7919}" for n in range(60)]
    rows = [(3 * n + k, text, f"{n}-{k}") for k in (2, 0, 1) for n, text in enumerate(texts)]
    path = str(tmp_path / "docs")
    docs = spark.createDataFrame(rows, "doc_id long, text string, _metadata string")
    docs.repartition(6, "doc_id").write.option("parquet.block.size", 1024).parquet(path)
    kept = simhash.one_of_each(spark.read.parquet(path), written=True)
    assert kept.columns == docs.columns
    want = sorted((r.doc_id, r.text, r._metadata) for r in simhash.one_of_each(docs).collect())
    assert len(want) > 50
    in_memory = simhash.one_of_each(docs, written=True)  # rows without a place in a file
    assert sorted((r.doc_id, r.text, r._metadata) for r in in_memory.collect()) == want
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "512")
        assert sorted((r.doc_id, r.text, r._metadata) for r in kept.collect()) == want
    finally:
        spark.conf.set(name, before)


def test_one_of_each_does_not_shuffle_the_texts(spark, tmp_path):
    """What tells the chosen rows from the others stays far smaller than a number for each."""
    n, path = 9000, str(tmp_path / "docs")
    text = F.concat_ws(" ", *(F.md5(F.concat(F.col("id") % 8000, F.lit(f"-{k}"))) for k in range(6)))
    spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(3).write.parquet(path)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "16k")
        kept = simhash.one_of_each(spark.read.parquet(path), written=True)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(8000))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        spark.conf.set(name, "-1")
        assert sorted(r.doc_id for r in simhash.one_of_each(spark.read.parquet(path), written=True).collect()) == list(range(8000))
    finally:
        spark.conf.set(name, before)


def test_no_aggregation_stands_right_before_the_join_of_a_round(spark):
    edges = spark.createDataFrame([(n, n // 2) for n in range(2, 40)] + [(7, 1)], "node long, to long")
    out = _towards_least(edges)
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.node, r.to): r.least for r in out.collect()} == {**{(n, n // 2): n // 2 for n in range(2, 40)}, (7, 3): 1, (7, 1): 1}
