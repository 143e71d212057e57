"""Event rates over streams: an extension beside the batch method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, length: str = "30 days", late: str = "1 day", ts: str = "ts") -> DataFrame:
    """window_start, user_id, event_type, n, total: tumbling windows of events (a stream or a table), late ones up to the watermark."""
    t = events.withWatermark(ts, late) if events.isStreaming else events
    g = t.groupBy(F.window(ts, length).alias("w"), "user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "user_id", "event_type", "n", "total")
