"""Starting streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Sink = Callable[[DataFrame, int], None]


def start(
    stream: DataFrame,
    sink: Sink,
    checkpoint: str,
    output_mode: str = "append",
    available_now: bool = False,
    every: str | None = None,
) -> StreamingQuery:
    """Feed each micro-batch to ``sink``; progress is kept in the shared folder ``checkpoint``."""
    writer = stream.writeStream.foreachBatch(sink).outputMode(output_mode).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def to_the_end(query: StreamingQuery) -> None:
    """Wait until a query over what is available now has finished."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
