"""Streaming counterparts: sessions by gap, and deduplicated appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(stream: DataFrame, key: str, time: str, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Gap sessions per key with a watermark; the same code runs on a batch."""
    s = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = s.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
