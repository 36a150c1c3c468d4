"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source has a target share of the mixture, and so a mean number of repetitions of its
documents: the rate. A hash of seed and document is a uniform number; the inverse of the Poisson
distribution with that rate turns it into a number of copies. So each document is decided on its
own and alike in every run, at any partitioning. The copies are dealt to partitions by another
hash and ordered by it: a global shuffle.

Sources are only counted; the rates are one row per source, written and read back, so Spark
broadcasts them only if their measured size is below its threshold, and otherwise joins (and
splits a source that holds much of the rows).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.session import stored

SEED = 20240607
TEMPERATURE = 0.5  # default target: shares in proportion to this power of the source's size
TOTAL = 1.0  # size of the mixture, in times that of the input
UNIT = 1 << 52


def uniform(*parts: Column) -> Column:
    """In [0, 1): 52 bits of the digest of the parts."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(UNIT)


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float = TOTAL, source_col: str = "source") -> DataFrame:
    """(source, n, rate): the mean number of copies of each document of a source, by which the
    mixture has ``total`` times as many documents as the input, shared out by ``weights``.

    Weights need not add up to one; a source without a weight gets none of the mixture. Without
    weights the shares follow the TEMPERATURE. The null source is a source.
    """
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.floor(F.pow(F.col("n").cast("double"), TEMPERATURE) * 1e6)
    else:
        known = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else F.lit(None).cast("map<string,double>")
        weight = F.floor(F.coalesce(known[F.col("source")], F.lit(0.0)) * 1e6)
    weighted = stored(docs.sparkSession, sizes.withColumn("weight", weight), "sizes")
    all_n, all_weight = weighted.agg(F.sum("n"), F.sum("weight")).first()  # two numbers
    if not all_weight:
        return weighted.select("source", "n", F.lit(0.0).alias("rate"))
    rate = F.lit(float(total)) * (F.col("weight").cast("double") / F.lit(float(all_weight))) * (F.lit(float(all_n)) / F.col("n"))
    return weighted.select("source", "n", rate.alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as double precision can tell it from one."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    first = F.exp(-rate)
    start = F.struct((-rate).alias("log_p"), first.alias("upto"), F.array(first).alias("steps"))

    def step(at, k):
        log_p = at["log_p"] + F.log(rate) - F.log(k.cast("double"))
        upto = at["upto"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), upto.alias("upto"), F.concat(at["steps"], F.array(upto)).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda at: at["steps"])).otherwise(F.array(F.lit(1.0)))


def mixed(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    total: float = TOTAL,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """The mixture: the columns of ``docs``, ``copy`` (from 1) and ``shuffle_key``, by which the
    rows of a partition are ordered.

    Rows that repeat an id are decided alike; rows with a null id too. Null texts are copied like
    any other. Columns of ``docs`` named copy or shuffle_key are replaced.
    """
    by_source = stored(docs.sparkSession, rates(docs, weights, total, source_col).withColumn("_steps", poisson_steps(F.col("rate"))), "rates")
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    row = docs.select(F.struct(*names).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_of"))
    chosen = row.join(by_source, F.col("_of").eqNullSafe(F.col("source")), "left")
    u = uniform(F.lit(seed), F.col("_id"))
    copies = F.size(F.filter(F.coalesce("_steps", F.array(F.lit(1.0))), lambda p: p <= u))
    copied = chosen.select("_row", "_id", copies.alias("_copies")).filter("_copies > 0")
    copied = copied.select("_row", "_id", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col("_id").cast("string"), F.lit("")), "copy"))
    return copied.select("_row.*", "copy", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def oracle(docs: str, columns: str, total: float = TOTAL, seed: int = SEED, temperature: float = TEMPERATURE) -> str:
    """The same in SQL, with the default weights; ``docs`` is a table, ``columns`` what it gives."""
    return f"""
WITH sizes AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
weighted AS (SELECT source, n, floor(pow(n::DOUBLE, {temperature}) * 1e6) AS w FROM sizes),
rates AS (SELECT source, {total} * (w / sum(w) OVER ()) * ((sum(n) OVER ())::DOUBLE / n) AS rate FROM weighted),
ks AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT + 1)) AS k FROM rates),
steps AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS p FROM ks),
drawn AS (SELECT *, (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT) / {UNIT}.0 AS u FROM {docs}),
counted AS (SELECT d.*, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.p <= d.u) AS copies FROM drawn d),
copied AS (SELECT *, unnest(range(1, copies + 1))::INTEGER AS copy FROM counted)
SELECT {columns}, copy, md5('{seed}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key FROM copied"""


SQL = oracle("documents", "doc_id, source, text")
