"""Pipelines over streams.

A pipeline keeps no state between rows, so it runs unchanged on a streaming
DataFrame: its column expressions as a projection, its kernels as one Arrow
stage of each micro-batch. ``windows`` puts event-time windows of values
together as lanes for pipelines that need a signal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Pipeline


def run(pipeline: Pipeline, stream: DataFrame, **options) -> DataFrame:
    """The pipeline's outputs as a streaming DataFrame."""
    if not stream.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    return pipeline.run(stream, **options)


def windows(stream: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """start, key, lane: the values of each key and window in the order of their
    times. Rows later than the watermark are dropped by Spark."""
    w = F.window(time, width)
    seen = stream.withWatermark(time, late).groupBy(w.alias("w"), key)
    lanes = seen.agg(F.sort_array(F.collect_list(F.struct(time, value))).alias("c"))
    return lanes.select(F.col("w.start").alias("start"), key, F.transform("c", lambda x: x[value].cast("double")).alias("lane"))


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream as Parquet until what is there has been read."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
