"""Streams: latest row of each key, and windowed counts with a watermark. An extension of the batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(stream: DataFrame, key: str, order: str) -> DataFrame:
    """In update or complete mode: the last row of each key so far."""
    rest = [c for c in stream.columns if c not in (key, order)]
    return stream.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("s")).select(key, f"s.{order}", *[f"s.{c}" for c in rest])


def tumbling(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts of each window; rows later than the watermark are left out."""
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def append_checkpointed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """JSON lines, appended once each: a restarted query goes on where the checkpoint stands."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
