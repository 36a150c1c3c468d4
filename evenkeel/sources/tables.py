"""Reading snapshots and change feeds, point lookups, and the append-only status log."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions._cols import as_list
from evenkeel.functions.names import blank_to_null
from evenkeel.operators.skew import null_spread

Schema = T.StructType | str


def _schema(schema: Schema) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_snapshot(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: Schema,
    fmt: str = "parquet",
    blank_as_null: Sequence[str] = (),
    payload: str | None = None,
    payload_schema: Schema | None = None,
    payload_error: str | None = None,
) -> DataFrame:
    """All objects of a kind, with a declared schema; nothing is inferred.

    ``blank_as_null`` names text columns in which an empty text means "not set". With
    ``payload``, that text column holds JSON and is replaced by the fields it declares, none of
    which may be named like another column. Text that is not such JSON gives nulls; with
    ``payload_error``, a column of that name then holds the text, else null.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.schema(_schema(schema)).format(fmt).load(paths)
    df = df.withColumns({c: blank_to_null(c) for c in blank_as_null})
    if payload:
        declared = _schema(payload_schema)
        others = [c for c in df.columns if c != payload] + ([payload_error] if payload_error else [])
        if clash := sorted(set(others) & set(declared.names)):
            raise ValueError(f"fields of the payload are named like columns: {clash}")
        bad = "_payload_error"
        wide = T.StructType([*declared.fields, T.StructField(bad, T.StringType())])
        parsed = F.from_json(F.col(payload), wide, {"columnNameOfCorruptRecord": bad})
        df = df.withColumn("_payload", parsed)
        fields = [F.col(f"_payload.`{f}`").alias(f) for f in declared.names]
        error = [F.col(f"_payload.{bad}").alias(payload_error)] if payload_error else []
        df = df.select(*(c for c in df.columns if c not in (payload, "_payload")), *fields, *error)
    return df


def read_changes(
    spark: SparkSession,
    path: str,
    schema: Schema,
    fmt: str = "parquet",
    stream: bool = True,
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """A change feed as a stream of new files, or as a table with ``stream=False``.

    ``max_files`` / ``max_bytes`` bound a micro-batch, and with it what one key can bring to
    a stateful operator at a time; Spark takes one of the two.
    """
    if max_files and max_bytes:
        raise ValueError("give max_files or max_bytes: Spark bounds a micro-batch by one of them")
    if not stream:
        return spark.read.schema(_schema(schema)).format(fmt).load(path)
    reader = spark.readStream.schema(_schema(schema)).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    elif max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path)


def lookup(df: DataFrame, keys: Mapping[str, Any]) -> DataFrame:
    """The object with these key values; an empty result means there is none."""
    for name, value in keys.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def lookup_many(
    wanted: DataFrame, table: DataFrame, keys: str | Sequence[str], found: str = "found"
) -> DataFrame:
    """Each wanted row with the columns of its object, and whether there is one.

    ``table`` has one row per key. Rows with a null key find nothing and are spread over the
    tasks; Spark broadcasts a small table, else splits a hot key of ``wanted``.
    """
    keys = as_list(keys)
    spread = null_spread([F.col(k) for k in keys], [F.col(c) for c in _plain(wanted)])
    have = table.withColumn("_spread", F.lit(0)).withColumn("_found", F.lit(True))
    return (
        wanted.withColumn("_spread", spread)
        .join(have, [*keys, "_spread"], "left")
        .withColumn(found, F.col("_found").isNotNull())
        .drop("_spread", "_found")
    )


def _plain(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]


def in_namespace(df: DataFrame, namespace: str, column: str = "namespace") -> DataFrame:
    """Rows of one namespace; a table partitioned by that column is pruned."""
    return df.filter(F.col(column) == namespace)


def with_labels(df: DataFrame, labels: Mapping[str, str], column: str = "labels") -> DataFrame:
    """Rows whose label map has all these exact values."""
    for name, value in labels.items():
        df = df.filter(F.col(column)[name] == value)
    return df


def append_status(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add observed state to an append-only Parquet log."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: one folder per micro-batch, written again if a batch is retried,
    so a replay after a lost driver adds nothing twice. Read it back as one table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
