"""Validation and deduplication of a stream. An extension: batch reports poll files, a stream needs no polling."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.validate import gate


def gated(stream: DataFrame, html: str = "html") -> DataFrame:
    """Adds the gate's verdict; stateless."""
    return stream.withColumn("reason", gate(html))


def first_seen(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key has not arrived within the delay; older keys leave the state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what has arrived and stops; called again, it goes on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
