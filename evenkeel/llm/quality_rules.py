"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Every document gets counts from its words and lines, and from them a vector of four transformed
statistics. Per language and source, and per language as a whole, a minimum-covariance-determinant
estimate is made: the mean and covariance of the half of a group's documents (with p statistics,
(n + p + 1) / 2 of n) that has the least determinant. It is looked for from several starts, each
made of medians and median deviations; a concentration step takes the half that lies closest to
the estimate so far, and steps go on until the determinant no longer falls. The estimate of the
least determinant over all starts is kept. So up to nearly half of a source may be junk.

A source's estimate is drawn towards its language's, by n / (n + SHRINK) at every size: a source
of few documents is mostly judged as its language is. Documents whose Mahalanobis distance is
beyond the chi-square quantile are rejected.

Medians and closest halves are found by counting documents per narrow bin of value or distance,
not by sorting a group: every step is one aggregation that is reduced before its shuffle, however
many documents a group has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenkeel.session import stored

CORE = 0.5  # part of a large group that the estimate rests on
STARTS = 3
FALL = 1e-6  # by which a step must lower the logarithm of the determinant to count
SHRINK = 200  # documents by which a source is drawn towards its language: its half must settle 14 parameters
ALL = "*"  # the part that is a whole language; those of sources begin with = or are NULL_SOURCE
NULL_SOURCE = "-"
CONFIDENCE = 0.9999  # chi-square probability beyond which a document is an outlier
BINS = 256  # bins per unit of a statistic
OCTAVE = 32  # bins per doubling of a squared distance
LEAST_WORDS, MOST_REPEATED = 50, 50
# Statistics and the spread below which differences of each don't count: added to the variance.
FLOORS = {"x0": 0.10, "x1": 0.05, "x2": 0.10, "x3": 0.15}
STATS = list(FLOORS)
SPACE = " \t\n\u000b\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi_square(d: int, x: float) -> float:
    """Probability that a chi-square variable of d degrees is at most x, by its series."""
    a, half = d / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= half / k
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(d: int, p: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(d, mid) < p else (low, mid)
    return high


LIMIT = chi_square_quantile(len(STATS), CONFIDENCE)
# The covariance of the closest part is smaller than that of all; this factor makes up for it.
CONSISTENCY = CORE / chi_square(len(STATS) + 2, chi_square_quantile(len(STATS), CORE))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus COUNTS (long): words, their characters, symbols, lines equal to an earlier
    one, and words in 3-word windows that occur twice or more.

    Null texts count as empty. Windows are compared by a 64-bit hash. All of a row's work is
    linear in its text, but for sorting its windows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = lambda c: F.size(c).cast("long")
    out = docs.withColumns(
        {
            "_words": F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != ""),
            "_lines": F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACE, "") != ""),
            "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "n_words": size("_words"),
            "n_dup_lines": size("_lines") - size(F.array_distinct("_lines")),
            "_lines_n": size("_lines"),
            "_windows": F.transform(
                F.arrays_zip(
                    F.col("_words").alias("a"),
                    F.slice("_words", 2, F.size("_words")).alias("b"),
                    F.slice("_words", 3, F.size("_words")).alias("c"),
                ),
                lambda w, i: F.struct(F.xxhash64(w["a"], w["b"], w["c"]).alias("h"), i.alias("i"), w["c"].isNotNull().alias("whole")),
            ),
        }
    )
    out = out.withColumn("_sorted", F.sort_array(F.transform(F.filter("_windows", lambda w: w["whole"]), lambda w: F.struct(w["h"], w["i"]))))
    # A window occurs again if a neighbour in the order of hashes has the same hash.
    after = F.slice("_sorted", 2, F.size("_sorted"))
    out = out.withColumn("_twins", F.zip_with(F.slice("_sorted", 1, F.greatest(F.size("_sorted") - 1, F.lit(0))), after, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
    out = out.withColumn("_again", F.sort_array(F.array_distinct(F.flatten(F.filter("_twins", lambda t: t.isNotNull())))))
    # Windows are three words long; each adds what the one before it has not covered.
    gaps = F.zip_with("_again", F.slice("_again", 2, F.size("_again")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    out = out.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda total, g: total + g).cast("long"))
    return out


def statistics(counts: DataFrame) -> DataFrame:
    """``counts`` plus the statistics x0..x3 and ``base_failed``: word length, symbols per word,
    part of repeated words, part of repeated lines. All are zero without words."""
    words = F.greatest("n_words", F.lit(1)).cast("double")
    return counts.withColumns(
        {
            "x0": F.log(F.greatest("word_chars", F.lit(1)) / words),
            "x1": F.log1p(F.col("n_symbols") / words),
            "x2": F.col("n_repeat_words") / words,
            "x3": F.col("n_dup_lines") / F.greatest("_lines_n", F.lit(1)),
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        }
    )


def _binned_medians(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """(lang, part, name, median): the median bin of each value column, by counting per bin."""
    long = rows.select("lang", "part", F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.floor(F.col(v) * BINS).alias("bin")) for v in values))).alias("s"))
    counted = long.groupBy("lang", "part", "s.name", "s.bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang", "part", "name")
    below = counted.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "all": F.sum("n").over(group)})
    return (
        below.filter(F.col("upto") * 2 >= F.col("all"))
        .groupBy("lang", "part", "name")
        .agg(((F.min("bin") + 0.5) / BINS).alias("median"))
    )


def _wide(medians: DataFrame, prefix: str) -> DataFrame:
    """One row per group, a column per statistic."""
    return medians.groupBy("lang", "part").agg(
        *(F.max(F.when(F.col("name") == v, F.col("median"))).alias(f"{prefix}{k}") for k, v in enumerate(sorted(FLOORS)))
    )


def _same_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the columns of their group; null languages and parts are groups of their own."""
    g = groups.withColumnsRenamed({"lang": "_lang", "part": "_part"})
    return rows.join(g, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("part").eqNullSafe(F.col("_part")), "left").drop("_lang", "_part")


GROUP = ["lang", "part", "start"]


def _closest(rows: DataFrame, distance: Column) -> DataFrame:
    """The half of each group and start that has the smallest squared distances, whole bins of them."""
    binned = rows.withColumn("_bin", F.floor(F.log2(distance + 1e-6) * OCTAVE))
    counted = binned.groupBy(*GROUP, "_bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*GROUP)
    half = F.least((F.col("all") + len(STATS) + 1) / 2, F.col("all"))
    reached = counted.withColumns({"upto": F.sum("n").over(group.orderBy("_bin")), "all": F.sum("n").over(group)}).filter(F.col("upto") >= half)
    last = stored(rows.sparkSession, reached.groupBy(*GROUP).agg(F.min("_bin").alias("_last")), "reach")
    return _same_start(binned, last).filter(F.col("_bin") <= F.col("_last"))


def _same_start(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the columns of their group and start."""
    g = groups.withColumnsRenamed({c: f"_{c}" for c in GROUP})
    on = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("part") == F.col("_part")) & (F.col("start") == F.col("_start"))
    return rows.join(g, on).drop(*(f"_{c}" for c in GROUP))


D = range(len(STATS))
PAIRS = [(i, j) for i in D for j in range(i + 1)]
MEANS, COVARIANCES, FACTORS = [f"m{i}" for i in D], [f"c{i}{j}" for i, j in PAIRS], [f"l{i}{j}" for i, j in PAIRS]


def _estimate(core: DataFrame) -> DataFrame:
    """Per group and start: means m*, covariances c**, Cholesky factor l**, log-determinant."""
    sums = core.groupBy(*GROUP).agg(
        *(F.avg(STATS[i]).alias(f"m{i}") for i in D), *(F.avg(F.col(STATS[i]) * F.col(STATS[j])).alias(f"c{i}{j}") for i, j in PAIRS)
    )
    floors = [FLOORS[s] for s in STATS]
    return factored(
        sums.withColumns({f"c{i}{j}": CONSISTENCY * (F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + (floors[i] ** 2 if i == j else 0.0) for i, j in PAIRS})
    )


def factored(out: DataFrame) -> DataFrame:
    """``out`` with covariances c** plus the lower Cholesky factor l** and ``log_det``."""
    for i, j in PAIRS:  # row by row, each from those above and to the left
        left = F.col(f"c{i}{j}")
        for k in range(j):
            left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(left) if i == j else left / F.col(f"l{j}{j}"))
    return out.withColumn("log_det", sum((2 * F.log(f"l{i}{i}") for i in D), F.lit(0.0)))


def with_distance(rows: DataFrame) -> DataFrame:
    """``rows`` that carry the estimate of their group, plus ``distance``: squared Mahalanobis."""
    total = F.lit(0.0)
    for i in range(len(STATS)):
        z = F.col(STATS[i]) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return rows.withColumn("distance", total)


def part_of(source: Column) -> Column:
    """The group of a source within its language; null and empty sources are apart."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(NULL_SOURCE))


def measured(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """COUNTS, statistics and ``base_failed`` of every row, with the columns of ``keep``: written
    once, so that the texts are read once. Column names of ``docs`` that are not named here are free."""
    narrow = docs.select(
        *(F.col(c).alias(f"_{c}") for c in keep),
        F.col(text_col).alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )
    found = statistics(word_counts(narrow)).select(*(f"_{c}" for c in keep), "lang", "source", *COUNTS, *STATS, "base_failed")
    return stored(docs.sparkSession, found, "statistics")


def _starts() -> list[Column]:
    """Squared distances from the medians: scaled by the median deviations and added up, the largest
    one of them alone, and scaled by the floors."""
    scaled = [F.pow(F.col(f"dev{k}"), 2) / (F.pow(F.col(f"mad{k}") * 1.4826, 2) + FLOORS[s] ** 2) for k, s in enumerate(STATS)]
    plain = [F.pow(F.col(f"dev{k}") / FLOORS[s], 2) for k, s in enumerate(STATS)]
    return [sum(scaled, F.lit(0.0)), F.greatest(*scaled), sum(plain, F.lit(0.0))]


def _better(now: DataFrame, new: DataFrame) -> DataFrame:
    """Each group's and start's estimate after a step, with ``fell``: whether the step was taken."""
    other = new.select(*GROUP, F.struct(*MEANS, *COVARIANCES, *FACTORS, "log_det").alias("_new"))
    fell = F.col("_new.log_det") < F.col("log_det") - FALL
    kept = [F.when(fell, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in (*MEANS, *COVARIANCES, *FACTORS, "log_det")]
    return _same_start(now.drop("fell"), other).select(*GROUP, *kept, fell.alias("fell"))


def fit(found: DataFrame) -> DataFrame:
    """The estimate per (lang, part) from all measured documents that pass the base rules."""
    spark = found.sparkSession
    found = found.filter(~F.col("base_failed"))
    # Every document counts in its source and in its language.
    rows = found.select("lang", F.explode(F.array(F.lit(ALL), part_of(F.col("source")))).alias("part"), *STATS)

    middle = stored(spark, _wide(_binned_medians(rows, STATS), "med"), "medians")
    centred = _same_group(rows, middle).withColumns({f"dev{k}": F.abs(F.col(s) - F.col(f"med{k}")) for k, s in enumerate(STATS)})
    deviation = _binned_medians(centred.select("lang", "part", *(F.col(f"dev{k}").alias(s) for k, s in enumerate(STATS))), STATS)
    spread = stored(spark, _wide(deviation, "mad"), "deviations")
    begun = F.explode(F.array(*(F.struct(F.lit(i).alias("start"), d.alias("distance")) for i, d in enumerate(_starts())))).alias("s")
    begun = _same_group(centred, spread).select("lang", "part", *STATS, begun).select("lang", "part", *STATS, "s.*")
    estimate = stored(spark, _estimate(_closest(begun, F.col("distance"))), "estimate")
    each = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    while True:
        core = _closest(with_distance(_same_start(each, estimate.select(*GROUP, *MEANS, *FACTORS))).select(*GROUP, *STATS, "distance"), F.col("distance"))
        estimate = stored(spark, _better(estimate, _estimate(core)), "estimate")
        if estimate.filter("fell").isEmpty():
            break
    least = F.min_by(F.struct(*MEANS, *COVARIANCES), F.struct("log_det", "start")).alias("_best")
    best = estimate.groupBy("lang", "part").agg(least).select("lang", "part", "_best.*")
    sizes = rows.groupBy("lang", "part").agg(F.count("*").alias("n"))
    return stored(spark, shrunk(_same_group(best, sizes)), "estimate")


def shrunk(best: DataFrame) -> DataFrame:
    """Estimates of sources drawn towards those of their languages, with factors."""
    names = [*MEANS, *COVARIANCES]
    whole = best.filter(F.col("part") == ALL).select(F.col("lang").alias("_lang"), *(F.col(c).alias(f"_{c}") for c in names))
    own = best.filter(F.col("part") != ALL).withColumn("_w", F.col("n") / (F.col("n") + SHRINK))
    both = own.join(whole, F.col("lang").eqNullSafe(F.col("_lang")))
    drawn = both.select("lang", "part", "n", *((F.col("_w") * F.col(c) + (1 - F.col("_w")) * F.col(f"_{c}")).alias(c) for c in names))
    return factored(drawn).drop(*COVARIANCES)


def judged(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Measured rows plus ``distance`` and ``kept``: false if the base rules fail or the distance
    is beyond LIMIT. A group without an estimate (none of its documents passes the base rules)
    rejects nothing more."""
    grouped = _same_group(rows.withColumn("part", part_of(F.col("source"))), estimate.drop("n", "log_det"))
    near = F.coalesce(F.col("distance") <= LIMIT, F.lit(True))
    return with_distance(grouped).withColumn("kept", ~F.col("base_failed") & near)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, COUNTS, ``base_failed``, ``distance`` and ``kept`` of every row of ``docs``.

    Null and empty texts have no words and fail; texts of any length are counted whole. Null
    languages and null or empty sources are values of their own. Rows aren't joined with each other, only
    with the estimate of their group, so repeated rows and null ids stay. An empty table gives no rows.
    """
    found = measured(docs, text_col, [id_col])
    return judged(found, fit(found)).select(F.col(f"_{id_col}").alias(id_col), *COUNTS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``.

    The statistics are worked out a second time beside the texts: written beside them, the texts
    would stand in the shared folder once more for as long as the result is read.
    """
    estimate = fit(measured(docs, text_col))
    row = F.struct(*docs.columns).alias("_row")
    narrow = docs.select(row, F.col(text_col).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    found = judged(statistics(word_counts(narrow)), estimate)
    # One comparison rather than two conditions: a filter on the base rules alone would be moved
    # to before the counts, and there repeat their work on every word.
    return found.filter(F.coalesce("distance", F.lit(0.0)) + F.when(F.col("base_failed"), 2 * LIMIT).otherwise(0.0) <= LIMIT).select("_row.*")
