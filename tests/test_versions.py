"""Row versions against a plain dictionary, and what a writer writes."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evenkeel import operators as O
from evenkeel.session import folders, remove_folder, shared_dir
from evenkeel.sources import RowVersions

DDL = "ns string, k int, v string"


def table(spark, **more):
    return RowVersions(spark, shared_dir(spark, "versions"), ["ns", "k"], DDL, **more)


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL + ", _gone boolean")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("partition_by", [(), "ns"])
def test_versions_against_a_dictionary(spark, partition_by):
    rng, kept, state, seen = random.Random(1), table(spark, partition_by=partition_by), {}, []
    assert rows(kept.read()) == []
    for version in range(7):
        changed = {(rng.choice("ab"), rng.randrange(8)): (f"v{version}", rng.random() < 0.2) for _ in range(6)}
        kept.write(frame(spark, [(*k, *v) for k, v in changed.items()]), version)
        state = {k: v for k, v in {**state, **changed}.items() if not v[1]}
        seen.append(sorted((*k, v[0]) for k, v in state.items()))
        if version in (2, 4):
            kept.compact(version)
    for version in range(1, 8):
        assert rows(kept.read(before=version)) == seen[version - 1]
    kept.trim()
    assert rows(kept.read()) == seen[-1] and rows(kept.read(before=5)) == seen[4]
    touched = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3)], "ns string, k int")
    assert rows(kept.read(touched=touched)) == [r for r in seen[-1] if r[:2] in {("a", 1), ("b", 2)}]
    assert rows(kept.read(where=F.col("ns") == "a")) == [r for r in seen[-1] if r[0] == "a"]


def test_a_version_written_again_replaces_itself(spark):
    kept = table(spark)
    kept.write(frame(spark, [("a", 1, "x", None)]), 0)
    kept.write(frame(spark, [("a", 1, "y", None), ("a", 2, "z", None)]), 1)
    kept.compact(1)
    kept.write(frame(spark, [("a", 1, "again", None)]), 1)  # run again after its own compaction
    kept.compact(1)
    assert rows(kept.read(before=1)) == [("a", 1, "x")] and rows(kept.read()) == [("a", 1, "again")]


def test_only_changed_rows_are_written(spark):
    """Bytes follow the touched keys, and the compacted table is that of apply_plan."""
    whole = spark.range(200_000).select(F.lit("a").alias("ns"), F.col("id").cast("int").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    kept = table(spark)
    kept.write(whole, 0)
    desired = whole.filter("k % 1000 = 0").withColumn("v", F.lit("new"))
    plan = O.reconcile_plan(desired, kept.read(touched=desired), ["ns", "k"])
    kept.write(plan.filter("action != 'NOOP'"), 1)

    def size(version):
        return sum(p.stat().st_size for p in Path(f"{kept.path}/rows/_version={version}").rglob("*.parquet"))

    assert size(1) < size(0) / 50
    kept.compact(1)
    applied = O.apply_plan(whole, plan, ["ns", "k"])
    assert kept.read().exceptAll(applied).count() == applied.exceptAll(kept.read()).count() == 0


def test_partitions_of_other_namespaces_are_not_read(spark):
    kept = table(spark, partition_by="ns")
    kept.write(frame(spark, [(n, 1, "x", None) for n in "abcdef"]), 0)
    read = kept.read(where=F.col("ns").isin("a", "c"))
    assert rows(read) == [("a", 1, "x"), ("c", 1, "x")]
    text = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[ns#\d+ IN \(a,c\)\]", text)


def test_folders_can_be_removed(spark):
    kept = table(spark)
    kept.write(frame(spark, [("a", 1, "x", None)]), 0)
    assert folders(spark, f"{kept.path}/rows") == ["_version=0"] and folders(spark, f"{kept.path}/none") == []
    remove_folder(spark, kept.path)
    assert rows(kept.read()) == []


def test_a_table_that_begins_whole_is_not_sorted_by_readers(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", 3)], "k string, v int")
    table = RowVersions(spark, shared_dir(spark, "begun"), "k", "k string, v int")
    table.begin(rows, 0)
    assert "Window" not in explained(table.read()) and "Exchange" not in explained(table.read())
    table.write(spark.createDataFrame([(None, 4), ("b", 5)], "k string, v int"), 1)
    assert sorted(map(tuple, table.read(1).collect()), key=str) == [("a", 1), ("b", 3), (None, 2)]
    assert sorted(map(tuple, table.read().collect()), key=str) == [("a", 1), ("b", 5), (None, 4)]
    assert table.written(1).count() == 2


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sorted_reading_gives_the_same_rows_with_one_shuffle(spark):
    rng, kept = random.Random(2), table(spark, sort_by="v")
    kept.begin(frame(spark, [(ns, k, "begun", None) for ns in ("a", None) for k in range(8)]).drop("_gone"), 0)
    assert "Window" not in explained(kept.read_sorted()) and kept.read_sorted().exceptAll(kept.read()).isEmpty()
    for version in range(1, 5):
        changed = {(rng.choice(["a", "b", None]), rng.randrange(8)): (f"v{version}", rng.random() < 0.3) for _ in range(6)}
        kept.write(frame(spark, [(*k, *v) for k, v in changed.items()]), version)
    for version in range(6):
        plain, ordered = kept.read(before=version), kept.read_sorted(before=version)
        assert sorted(map(tuple, ordered.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    plan = O.reconcile_plan(kept.read().select("ns", "k", "v"), kept.read_sorted(), ["ns", "k"])
    side = explained(plan).partition("SortMergeJoin")[2]
    assert "_later" in side and "WindowGroupLimit" not in explained(plan)
    assert explained(kept.read_sorted()).count("Exchange") == 1


def test_rows_of_a_file_are_in_order(spark):
    kept = table(spark, sort_by="v")
    kept.begin(spark.range(2000).select(F.lit("a").alias("ns"), F.col("id").cast("int").alias("k"), F.concat(F.lit("v"), F.col("id") % 7).alias("v")), 0)
    for path in Path(f"{kept.path}/base/_version=0").rglob("*.parquet"):
        read = [r.v for r in spark.read.parquet(str(path)).collect()]
        assert read == sorted(read)
    assert kept.read().count() == 2000
