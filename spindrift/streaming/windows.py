"""Event-time windows, beyond what the reference has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour", streaming: bool = False) -> DataFrame:
    """``(event_type, day, n)`` by windows of event time. On a stream, time is cast to an instant, as watermarks ask for, and
    events later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if streaming else timed
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("day"), "n")
