"""Collecting queries and reading the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.session import shared_dir
from evenkeel.sources import read_changes, read_snapshot

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    """Register a query and the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_snapshot(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


FEED_SLICES, SLICE_FILE_ROWS = 5, 500_000


def feed(spark: SparkSession, sf_dir: str, name: str = "events", ts: str = "ts") -> DataFrame:
    """A table replayed as a stream of about FEED_SLICES micro-batches in the order of time.

    Equal spans of time are written one after the other to the shared folder, and the file source
    takes files by their age. A micro-batch has as many files as a span of mean size.
    """
    rows, place = table(spark, sf_dir, name), shared_dir(spark, f"feed-{name}")
    n, first, last = rows.agg(F.count("*"), F.min(_micros(ts)), F.max(_micros(ts))).first()
    files = max(1, -(-n // (FEED_SLICES * SLICE_FILE_ROWS)))
    width = max(1, ((last or 0) - (first or 0)) // FEED_SLICES + 1)
    # Rows without a time come first, as they do in an order by time.
    slice_of = F.coalesce(F.floor((_micros(ts) - F.lit(first)) / F.lit(width)), F.lit(0))
    for k in range(FEED_SLICES):
        rows.filter(slice_of == k).repartition(files).write.mode("append").parquet(place)
    return read_changes(spark, place, SCHEMAS[name], max_files=files)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))
