"""Streaming forms of dedup and upsert over files of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drain(stream: DataFrame, checkpoint: str, sink: str) -> None:
    """Run a stream over all that is there, appending to the Parquet table ``sink``."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/{uuid.uuid4().hex}").option("path", sink).trigger(availableNow=True).start()
    q.awaitTermination()


def dedup(stream: DataFrame, key: str, at: str, lateness: str) -> DataFrame:
    """The first arrival of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, length: str, lateness: str, by: list[str]) -> DataFrame:
    """Counts per tumbling window, emitted once the watermark closes it."""
    return stream.withWatermark(at, lateness).groupBy(F.window(at, length), *by).agg(F.count("*").alias("n"))
