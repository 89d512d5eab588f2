"""Keyed aggregation over streams: an extra beyond the batch core, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.aggregators import BY_NAME, Algebraic


def reduce_by_key_window(events: DataFrame, time: str, key: Column, value: Column, combiner: Algebraic | str, window: str, lateness: str) -> DataFrame:
    """``reduce_by_key`` per event-time window; rows later than ``lateness`` are dropped by the watermark."""
    c = BY_NAME[combiner] if isinstance(combiner, str) else combiner
    rows = events.withWatermark(time, lateness).select(F.window(time, window).alias("w"), key.alias("key"), value.alias("value"))
    out = rows.groupBy("w", "key").agg(c.aggregate(F.col("value")).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), "key", "value")


def word_count_stream(lines: DataFrame) -> DataFrame:
    """Running word count of a stream with a ``value`` column; use with output mode complete or update."""
    words = lines.select(F.explode(F.split("value", " ")).alias("key"))
    return words.groupBy("key").agg(F.count(F.lit(1)).alias("value"))
