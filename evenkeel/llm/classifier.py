"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class is a normal distribution over transformed counts of the text. Its covariance is shrunk
towards that of all classes and towards the diagonal, so that a statistic that hardly varies in a
class stays usable. The score is the logistic of the difference of the log densities, each from a
Mahalanobis distance by the Cholesky factor of its class, which is worked out once.

The texts are read once; sums and products of the statistics per class are the only thing that
reaches the driver, a fixed number of values whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.session import ship_package, stored

POOLED, DIAGONAL = 0.10, 0.20  # parts of the pooled and of the diagonal covariance
FLOOR = 0.05  # standard deviation added to every statistic
THRESHOLD = 0.7
TEMPER = 0.25  # log densities of dependent statistics overstate; this scales their difference
FEATURES = ["f_words", "f_length", "f_symbols", "f_points", "f_upper", "f_digits", "f_variety", "f_windows", "f_lines"]
SYMBOLS, POINTS = b"#*$%&|<>", b"!?.,;:"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def features(text: str | None) -> list[float]:
    """Transformed statistics of one text; all well defined for an empty one."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    windows = max(1, len(words) - 2)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [
        np.log1p(len(words)),
        np.log(max(1, sum(map(len, words))) / n),
        np.log1p(10 * count(SYMBOLS) / n),
        np.log1p(10 * count(POINTS) / n),
        np.sqrt(count(UPPER) / size),
        np.sqrt(count(DIGITS) / size),
        # Variety falls with length as such; against the square root it is about level.
        np.log(max(1, len(set(words))) / n**0.9),
        np.sqrt(max(0, windows - max(1, len(set(zip(words, words[1:], words[2:]))))) / windows),
        np.sqrt((len(lines) - len(set(lines))) / max(1, len(lines))),
    ]


def _features(batches):
    for batch in batches:
        values = np.array([features(t) for t in batch.column(0).to_pylist()], np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], *(pa.array(values[:, k]) for k in range(len(FEATURES)))], names=[*batch.schema.names[1:], *FEATURES]
        )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and FEATURES of every row."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    return narrow.mapInArrow(_features, f"id {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Discriminant:
    """Means, Cholesky factors (None: there is only one class) and log priors of classes 0 and 1."""

    means: list[np.ndarray] | None
    factors: list[np.ndarray] | None
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        margin = np.full(len(x), self.log_odds)
        if self.factors is not None:
            log_density = [
                -0.5 * (np.linalg.solve(factor, (x - mean).T) ** 2).sum(axis=0) - np.log(np.diag(factor)).sum()
                for mean, factor in zip(self.means, self.factors)
            ]
            margin = margin + TEMPER * (log_density[1] - log_density[0])
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def fit(labelled: DataFrame, label_col: str = "quality") -> Discriminant:
    """From rows of FEATURES with a label 0 or 1; rows with another or a null label don't count.

    Without rows of both classes every text gets the same score: the smoothed share of class 1.
    """
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[: i + 1]]
    sums = (
        labelled.filter(F.col(label_col).isin(0, 1))
        .groupBy(F.col(label_col).cast("int").alias("label"))
        .agg(F.count("*").alias("n"), F.array(*(F.sum(f) for f in FEATURES)).alias("s"), F.array(*(F.sum(F.col(a) * F.col(b)) for a, b in pairs)).alias("p"))
    )
    rows = {r.label: r for r in sums.collect()}  # at most two rows
    n = [rows[c].n if c in rows else 0 for c in (0, 1)]
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if not all(n):
        return Discriminant(None, None, odds)
    d = len(FEATURES)
    means, covariances = [], []
    for c in (0, 1):
        mean = np.array(rows[c].s) / n[c]
        second = np.zeros((d, d))
        second[np.tril_indices(d)] = rows[c].p
        second = second + np.tril(second, -1).T
        means.append(mean)
        covariances.append(second / n[c] - np.outer(mean, mean))
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / sum(n)
    factors = []
    for own in covariances:
        mix = (1 - POOLED - DIAGONAL) * own + POOLED * pooled + DIAGONAL * np.diag(np.diag(own)) + FLOOR**2 * np.eye(d)
        factors.append(np.linalg.cholesky(mix))
    return Discriminant(means, factors, odds)


def scored(found: DataFrame, model: Discriminant) -> DataFrame:
    """id and ``score`` of measured rows."""

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(k + 1).to_numpy() for k in range(len(FEATURES))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    return found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, score double")


def held_out(id_column: Column, parts: int = 4, part: int = 2) -> Column:
    """True for ids of the part that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string")) % parts == part, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every row of ``docs``.

    Learned from the rows of ``labels`` that are not held out; a repeated label counts again. Null
    and empty texts are scored by their (empty) statistics. A null id is scored, never learned from.
    """
    found = stored(docs.sparkSession, measured(docs, id_col, text_col), "features")
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label")).filter(~held_out(F.col("label_id")))
    model = fit(found.join(known, found["id"] == known["label_id"]), "label")
    return scored(found, model).select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
