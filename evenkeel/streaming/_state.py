"""Shared pieces of the stateful functions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def micros(ts: pd.Series) -> np.ndarray:
    """Timestamps as microseconds, the form in which state keeps them."""
    return ts.to_numpy(dtype="datetime64[us]").astype("int64")


def newer(us: np.ndarray, seq: np.ndarray, last: tuple[int, int] | None) -> np.ndarray:
    """Rows after the stored (ts, seq); older ones are late or replayed."""
    if last is None:
        return np.ones(len(us), dtype=bool)
    return (us > last[0]) | ((us == last[0]) & (seq > last[1]))


def parted(pdf: pd.DataFrame, ts: str, seq: str, last: tuple[int, int] | None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(rows after the stored one, rows before it); a replay of the stored row itself is neither."""
    us, no = micros(pdf[ts]), pdf[seq].to_numpy(dtype="int64")
    fresh = newer(us, no, last)
    if last is None or fresh.all():
        return pdf, pdf[:0]
    return pdf[fresh], pdf[~fresh & ~((us == last[0]) & (no == last[1]))]


def parted_chunks(chunks: Iterator[pd.DataFrame], ts: str, seq: str, last: tuple[int, int] | None):
    """``parted`` of all chunks together."""
    fresh, late = zip(*(parted(pdf, ts, seq, last) for pdf in chunks))
    return (parts[0] if len(parts) == 1 else pd.concat(parts) for parts in (fresh, late))


def fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]
