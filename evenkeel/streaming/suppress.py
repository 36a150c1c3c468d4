"""Dropping updates that change nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evenkeel.functions._cols import as_list
from evenkeel.operators.rows import SLICES, slice_cuts, with_previous
from evenkeel.streaming._keyed import keep_state, last_rows, parted, state_table
from evenkeel.streaming.writing import Sink, start

LOSSLESS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def suppress_unchanged(
    stream: DataFrame,
    sink: Sink,
    checkpoint: str,
    state: str,
    keys: str | Sequence[str],
    content: Sequence[str],
    ts: str = "ts",
    seq: str = "seq",
    slices: int = SLICES,
    **trigger,
) -> StreamingQuery:
    """Per micro-batch (keys, ts, seq, content, late) of the rows whose content differs from the
    key's previous row.

    For feeds that carry only the after-image; with before and after images the stateless
    ``content_changed`` does it. A digest of the last row of each key is kept in the folder
    ``state`` as versions by micro-batch and stands before the rows of the next. The digest is of a
    lossless text (times to the microsecond), so content in any type, maps included, is compared.
    Rows before the stored one can't be compared any more; they are given with ``late`` true. A
    replay of the stored row gives nothing.
    """
    keys, content, order = as_list(keys), list(content), [ts, seq]
    kinds = {f.name: f.dataType for f in stream.schema}
    parts = [F.sort_array(F.map_entries(c)).alias(c) if isinstance(kinds[c], T.MapType) else F.col(c) for c in content]
    digest = F.sha2(F.to_json(F.struct(*parts), LOSSLESS), 256)
    names = list(dict.fromkeys([*keys, ts, seq, *content]))
    kept = state_table(stream, state, keys, [ts, seq], [T.StructField("_digest", T.StringType())])

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(*names, digest.alias("_digest")).persist()
        before = last_rows(kept, batch, order, batch_id).persist()
        rows = parted(batch, before, keys, order)
        fresh = rows.filter("_when = 1")
        log = fresh.unionByName(before.withColumn("_when", F.lit(0)), allowMissingColumns=True)
        compared = with_previous(log, keys, order, ["_digest"], slice_cuts(batch, order, slices)).filter("_when = 1")
        changed = compared.filter(F.col("_prev").isNull() | (F.col("_prev._digest") != F.col("_digest")))
        out = changed.select(*names, F.lit(False).alias("late")).unionByName(rows.filter("_when = -1").select(*names, F.lit(True).alias("late")))
        last = fresh.groupBy(*keys).agg(F.max(F.struct(ts, seq, "_digest")).alias("_row")).select(*keys, "_row.*")
        try:
            sink(out, batch_id)
            keep_state(kept, last, batch_id)
        finally:
            before.unpersist()
            batch.unpersist()

    return start(stream, each, checkpoint, **trigger)
