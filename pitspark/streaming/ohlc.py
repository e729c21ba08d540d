"""Streams of events to bars, with watermarks and deduplication; the same columns as the batch adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ohlc(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour", key: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Bars per window from a stream (or batch) of events. A zone-free time is read as UTC."""
    at = F.col(ts).cast("timestamp")
    e = events.select(F.col(key).alias("symbol"), at.alias("at"), F.col(value).alias("v"))
    e = e.withWatermark("at", late) if e.isStreaming else e
    w = F.window("at", size, slide) if slide else F.window("at", size)
    bars = e.groupBy("symbol", w.alias("w")).agg(F.min_by("v", "at").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "at").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select("symbol", F.unix_millis("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions per key: start, end and number of events."""
    e = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("at"))
    e = e.withWatermark("at", late) if e.isStreaming else e
    s = e.groupBy("key", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("key", F.unix_millis("w.start").alias("start"), F.unix_millis("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events once per keys; on a stream within the watermark."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return e.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if e.isStreaming else e.dropDuplicates(keys)


def available(bars: DataFrame, decision: str = "decision_ts") -> DataFrame:
    """The point-in-time gate on a stream of (bar, decision) rows."""
    return bars.where(F.coalesce("available_time", "ts") <= F.col(decision))
