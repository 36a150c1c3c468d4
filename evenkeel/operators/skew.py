"""Keeping hot keys out of single tasks.

Most operators need nothing from here: they are narrow, or aggregate before the shuffle,
or join in a way that adaptive execution can split (no aggregation on the join key follows).
The helpers cover the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def null_spread(keys: Sequence[Column], by: Sequence[Column], buckets: int = 1024) -> Column:
    """An extra join key that spreads rows with a null key, which match nothing, over tasks.

    The other side of the join carries a literal 0.
    """
    missing = F.lit(False)
    for k in keys:
        missing = missing | k.isNull()
    return F.when(missing, spread(by, buckets)).otherwise(F.lit(0))


def spread(by: Sequence[Column], buckets: int = 1024) -> Column:
    """A bucket number that depends on nothing but the given values."""
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")
