"""A keyed table kept as versions of its rows, for writers that change few rows at a time.

A writer appends the rows that it changes as one version; nothing else is written again. Readers
merge: a key's row is that of its latest version, or of the last compaction. A version is one
folder that is written over when it is written again, and a reader names the version before which
it reads, so a micro-batch that runs twice reads the same state and leaves the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions._cols import as_list
from evenkeel.session import folders, remove_folder

GONE, VERSION = "_gone", "_version"


class RowVersions:
    """The table below ``path``: ``schema`` with unique ``keys``, optionally partitioned by some of
    its columns, so that readers who filter on those read no other folders. The rows of a file are
    in the order of ``sort_by``, so that readers who filter on that skip most of it.

    Versions are whole numbers, micro-batches from 0 on; ``before`` leaves out that version and all later ones. Rows of a
    version are unique by key. A key whose row has GONE true is no longer there.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: str | Sequence[str], schema: T.StructType | str, partition_by: str | Sequence[str] = (),
        sort_by: str | Sequence[str] = (),
    ):
        self.spark, self.path, self.keys, self.partition_by = spark, path.rstrip("/"), as_list(keys), as_list(partition_by)
        self.sort_by = as_list(sort_by)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(name.partition("=")[2]) for name in folders(self.spark, f"{self.path}/{kind}") if name.startswith(f"{VERSION}="))

    def _read(self, kind: str, numbers: list[int]) -> DataFrame:
        """Rows of some versions, with their version; the files of others are not listed."""
        wanted = T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType()), T.StructField(VERSION, T.LongType())])
        if not numbers:
            # A plan that Spark sees to be empty: joins with it go away.
            return self.spark.range(1).filter(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))
        reader = self.spark.read.schema(wanted).option("basePath", f"{self.path}/{kind}")
        return reader.parquet(*(f"{self.path}/{kind}/{VERSION}={n}" for n in numbers)).select(*wanted.names)

    def _kept(self, before: int | None, base_before: int | None = None) -> tuple[list[int], list[int]]:
        """(number of the last compaction, those written since), of versions before ``before``."""
        limit = before if base_before is None else base_before
        bases = [n for n in self._numbers("base") if limit is None or n < limit]
        newer = [n for n in self._numbers("rows") if (not bases or n > bases[-1]) and (before is None or n < before)]
        return bases[-1:], newer

    def _parts(self, before: int | None, base_before: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The rows of ``_kept``."""
        base, newer = self._kept(before, base_before)
        return self._read("base", base), self._read("rows", newer)

    def read(
        self, before: int | None = None, where: Column | None = None, touched: DataFrame | None = None, on: Sequence[str] | None = None
    ) -> DataFrame:
        """The table as of the versions before ``before``; of rows ``where`` a condition on columns
        that don't change holds, and of keys that are in ``touched`` (all key columns, or those
        in ``on``; repeats don't matter).

        Rows of the last compaction are not shuffled where the keys written since are few.
        """
        return self._merged(*self._parts(before), where, touched, on)

    def _merged(
        self, base: DataFrame, newer: DataFrame, where: Column | None = None, touched: DataFrame | None = None, on: Sequence[str] | None = None
    ) -> DataFrame:
        if where is not None:
            base, newer = base.filter(where), newer.filter(where)
        if touched is not None:
            on = list(on or self.keys)
            base, newer = (df.join(touched.select(*on), on, "left_semi") for df in (base, newer))
        newer = self._latest(newer)
        later = newer.select(*(F.col(k).alias(f"_later_{k}") for k in self.keys))
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_later_{k}")) for k in self.keys))
        kept = base.join(later, same, "left_anti").unionByName(newer)
        return kept.filter(~F.coalesce(F.col(GONE), F.lit(False))).select(*self.columns)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """The row of the latest version of each key. Few keys have many rows: a rank as filter would
        make Spark sort the rows once more before they move."""
        latest = Window.partitionBy(*self.keys).orderBy(F.desc(VERSION))
        return rows.withColumn("_later", F.lag(F.lit(1)).over(latest)).filter("_later IS NULL").drop("_later")

    def read_sorted(self, before: int | None = None) -> DataFrame:
        """``read`` where many keys have been written since the last compaction: all rows are moved
        and sorted once by their keys, and a merge join on these need not do it again."""
        bases, since = self._kept(before)
        rows = self._read("base", bases)
        if since:
            rows = self._latest(rows.unionByName(self._read("rows", since)))
        return rows.filter(~F.coalesce(F.col(GONE), F.lit(False))).select(*self.columns)

    def history(self, before: int | None = None) -> DataFrame:
        """All rows that are kept, of all versions before ``before``, removed ones left out: for
        tables whose rows tell by themselves which of a key is the latest."""
        base, newer = self._parts(before)
        return base.unionByName(newer).filter(~F.coalesce(F.col(GONE), F.lit(False))).select(*self.columns)

    def written(self, version: int) -> DataFrame:
        """The rows that a version changed, with GONE."""
        return self._read("rows", [version]).drop(VERSION)

    def write(self, rows: DataFrame, version: int) -> None:
        """The rows that this version changes, and nothing else; GONE is optional."""
        gone = F.col(GONE) if GONE in rows.columns else F.lit(False)
        self._write(rows.select(*self.columns, gone.alias(GONE)), "rows", version)

    def begin(self, rows: DataFrame, version: int) -> None:
        """The whole table as of ``version``, kept like a compaction: readers need not sort it to find
        the latest rows, only what was written since. Of rows with one key one is kept."""
        first = rows.select(*self.columns, F.lit(False).alias(GONE), F.lit(version).cast("long").alias(VERSION))
        self._write(self._merged(self._read("base", []), first).withColumn(GONE, F.lit(False)), "base", version)

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        if self.sort_by:
            rows = rows.sortWithinPartitions(*self.partition_by, *self.sort_by)
        writer = rows.write.mode("overwrite")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(f"{self.path}/{kind}/{VERSION}={version}")

    def compact(self, version: int) -> None:
        """Write the whole table as of ``version``; later reads begin there. Done again, it doesn't
        read what it wrote before."""
        self._write(self._merged(*self._parts(version + 1, version)).withColumn(GONE, F.lit(False)), "base", version)

    def trim(self) -> None:
        """Remove what no reader needs: all before the last compaction but one, so that a version
        that is written again still finds the state before it."""
        bases = self._numbers("base")
        if len(bases) > 1:
            for kind, last in (("base", bases[-2] - 1), ("rows", bases[-2])):
                for n in self._numbers(kind):
                    if n <= last:
                        remove_folder(self.spark, f"{self.path}/{kind}/{VERSION}={n}")
