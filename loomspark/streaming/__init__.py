"""Structured Streaming into run-scoped sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import Sink
from ..sources import get_sink


def stream_runs(df: DataFrame, sink: Sink, name: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch as the run ``<name>-<batch>``; a batch that is repeated after a failure changes nothing."""
    target = get_sink(sink.connector)(**sink.options)

    def write(batch: DataFrame, number: int) -> None:
        target.write(batch, f"{name}-{number}")

    return df.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
