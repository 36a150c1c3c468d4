"""Job progress on a stream, with a state per key that does not grow with what was installed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evenkeel.functions._cols import as_list
from evenkeel.operators.jobs import CLEAR
from evenkeel.session import ship_package
from evenkeel.sources.versions import RowVersions
from evenkeel.streaming._keyed import keep_state, last_rows, parted, state_table
from evenkeel.streaming._state import fields
from evenkeel.streaming.jobs import LATE, next_step
from evenkeel.streaming.writing import Sink, start

ITEM = "_item"
LIST = T.ArrayType(T.StringType())
COUNTERS = ("succeeded", "active", "failed")
# Equal observations lead at most through CLEAR, START and CLEAR to a step that then repeats.
STEADY = 4


def job_steps(
    stream: DataFrame,
    sink: Sink,
    checkpoint: str,
    state: str,
    keys: str | Sequence[str] = ("namespace", "object"),
    ts: str = "ts",
    seq: str = "seq",
    desired: str = "desired",
    **trigger,
) -> StreamingQuery:
    """Per micro-batch (keys, ts, seq, action, items, retry_after_s, next_attempt_at): the steps of
    ``track_jobs`` without its installed list, which is read off the CLEAR rows with
    ``installed_items``.

    Below the folder ``state`` are two tables, kept as versions by micro-batch: the recorded job and
    last observation of each key, and the installed items as rows (keys, item). A micro-batch looks
    up only the items that it names, so what a key brings into memory depends on the micro-batch,
    not on its history. Of a run of equal observations only the first few take part in the walk
    through a key's rows, which goes row by row in a task; the rest repeat the last of these. An
    observation before the stored one gives a row LATE, a replay of the stored one nothing. A null
    list is an empty one, a null counter zero; null keys are a key.
    """
    ship_package(stream.sparkSession)
    keys, order = as_list(keys), [ts, seq]
    kept = state_table(stream, f"{state}/jobs", keys, order, [T.StructField("_job", LIST)])
    item = T.StructField(ITEM, T.StringType())
    installed = RowVersions(stream.sparkSession, f"{state}/installed", [*keys, ITEM], T.StructType([*fields(stream, keys), item, *fields(stream, order)]))
    key, instant = F.struct(*keys).alias("_key"), F.struct(*order)
    flags = [F.coalesce(F.col(c) > 0, F.lit(False)).alias(f"_{c}") for c in COUNTERS]
    observed = F.struct("_wanted", *(f"_{c}" for c in COUNTERS))
    named = T.StructType([*fields(stream, [*keys, *order]), T.StructField("_run", T.LongType()), T.StructField("_place", T.IntegerType())])
    walked = T.StructType([*named.fields, *(T.StructField(n, t) for n, t in (("action", T.StringType()), ("items", LIST), ("retry_after_s", T.IntegerType()), ("_job", LIST)))])

    def in_runs(rows: DataFrame) -> DataFrame:
        along = Window.partitionBy(*keys).orderBy(*order)
        before = F.lag(F.struct(observed.alias("o"))).over(along)
        moved = rows.withColumn("_moved", (before.isNull() | ~before["o"].eqNullSafe(observed)).cast("long"))
        runs = moved.withColumn("_run", F.sum("_moved").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        return runs.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order))).drop("_moved")

    def seeds(rows: DataFrame, before: DataFrame, batch_id: int) -> DataFrame:
        """A row per key that stands before its own: the recorded job, and which of the items that the
        rows name are installed."""
        wanted = rows.select(*keys, F.explode("_wanted").alias(ITEM)).distinct()
        have = last_rows(installed, wanted, order, batch_id).groupBy(key).agg(F.collect_list(F.struct(ITEM)).alias("_have"))
        jobs = before.select(key, "_job")
        found = rows.select(key).distinct().join(jobs, "_key", "left").join(have, "_key", "left")
        return found.select("_key.*", "_job", F.transform("_have", lambda x: x[ITEM]).alias("_have"), F.lit(True).alias("_seed"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, have = None, set()
        for batch in batches:
            steps = []
            for row in batch.select(["_seed", "_job", "_have", "_wanted", *(f"_{c}" for c in COUNTERS)]).to_pylist():
                if row["_seed"]:
                    job, have = row["_job"], set(row["_have"] or ())
                    continue
                action, items, delay, job = next_step(job, have, row["_wanted"], *(row[f"_{c}"] for c in COUNTERS))
                if action == CLEAR:
                    have.update(items)
                steps.append((action, items, delay, job))
            own = batch.filter(pc.invert(batch.column("_seed"))).select(named.names)
            kinds = (pa.string(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.string()))
            said = [pa.array([s[i] for s in steps], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*own.columns, *said], names=walked.names)

    def each(batch: DataFrame, batch_id: int) -> None:
        seen = batch.select(*keys, *order, F.col(desired).cast(LIST).alias("_wanted"), *flags).persist()
        before = last_rows(kept, seen, order, batch_id).persist()
        rows = parted(seen, before, keys, order)
        runs = in_runs(rows.filter("_when = 1")).persist()
        first = runs.filter(F.col("_place") <= STEADY)
        log = first.withColumn("_seed", F.lit(False)).unionByName(seeds(first, before, batch_id), allowMissingColumns=True)
        steps = log.repartition(*keys).sortWithinPartitions(*keys, F.desc("_seed"), *order).mapInArrow(walk, walked).persist()
        steady = steps.filter(F.col("_place") == STEADY).select(key, "_run", "action", "items", "retry_after_s", "_job")
        more = runs.filter(F.col("_place") > STEADY).select(key, *keys, *order, "_run").join(steady, ["_key", "_run"])
        columns = [*keys, *order, "action", "items", "retry_after_s", "_job"]
        told = steps.select(*columns).unionByName(more.select(*columns)).persist()
        late = rows.filter("_when = -1").select(*keys, *order, F.lit(LATE).alias("action"), F.array().cast(LIST).alias("items"))
        due = (F.col(ts) + F.make_dt_interval(secs=F.col("retry_after_s"))).alias("next_attempt_at")
        last = told.groupBy(*keys).agg(F.max_by("_job", instant).alias("_job"), F.max(instant).alias("_at")).select(*keys, "_at.*", "_job")
        new = told.filter(F.col("action") == CLEAR).select(*keys, *order, F.explode("items").alias(ITEM))
        try:
            sink(told.drop("_job").unionByName(late, allowMissingColumns=True).select("*", due), batch_id)
            keep_state(installed, new, batch_id)
            keep_state(kept, last, batch_id)
        finally:
            for held in (told, steps, runs, before, seen):
                held.unpersist()

    return start(stream, each, checkpoint, **trigger)
