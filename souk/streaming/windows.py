"""Time-bounded activity: windows and sessions with a watermark.

The functions accept a static or a streaming frame.  In a stream, event times
are cast to a zoned timestamp, since only those can carry a watermark; run it
with a UTC session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exact import exact_sum, units


def timed(events: DataFrame, watermark: str) -> DataFrame:
    if not events.isStreaming:
        return events.withColumn("event_time", F.col("event_timestamp"))
    at = F.col("event_timestamp").cast("timestamp")
    return events.withColumn("event_time", at).withWatermark("event_time", watermark)


def deduplicated(events: DataFrame, watermark: str) -> DataFrame:
    """Drops redelivered events; a stream remembers ids for the watermark delay."""
    if not events.isStreaming:
        return timed(events, watermark).dropDuplicates(["event_id"])
    return timed(events, watermark).dropDuplicatesWithinWatermark(["event_id"])


def windowed_activity(
    events: DataFrame, length: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes"
) -> DataFrame:
    """Orders and value per customer and (sliding) window."""
    at = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    counted = timed(events, watermark).groupBy(at.alias("w"), "customer_id").agg(
        F.count("*").alias("orders"), exact_sum(F.col("order_value")).alias("value")
    )
    return _flat(counted, "customer_id")


def session_activity(
    events: DataFrame, gap: str = "6 hours", watermark: str = "10 minutes"
) -> DataFrame:
    """Orders and value per customer session; a session ends after ``gap`` of silence."""
    if not events.isStreaming:
        return _stored_sessions(events, gap)
    sessions = timed(events, watermark).groupBy(
        F.session_window("event_time", gap).alias("w"), "customer_id"
    )
    counted = sessions.agg(
        F.count("*").alias("orders"), exact_sum(F.col("order_value")).alias("value")
    )
    return _flat(counted, "customer_id")


def _stored_sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of a stored table, without bringing a customer's events together.

    Events of one customer inside a bucket as wide as the gap are always in
    the same session, so they are first reduced to one row per (customer,
    bucket).  Only those rows, whose number depends on the time span and not
    on the number of events, are put in order per customer.
    """
    c, silence = F.col, F.expr(f"INTERVAL '{gap}'")
    buckets = events.groupBy("customer_id", F.window("event_timestamp", gap).alias("bucket")).agg(
        F.min("event_timestamp").alias("first"),
        F.max("event_timestamp").alias("last"),
        F.count("*").alias("orders"),
        F.sum(units(c("order_value"))).alias("units"),
    )
    inorder = Window.partitionBy("customer_id").orderBy("first")
    starts = F.when(c("first") > F.lag("last").over(inorder) + silence, 1).otherwise(0)
    numbered = buckets.withColumn("start", starts).withColumn(
        "session", F.sum("start").over(inorder)
    )
    return (
        numbered.groupBy("customer_id", "session")
        .agg(
            F.min("first").alias("window_start"),
            (F.max("last") + silence).alias("window_end"),
            F.sum("orders").alias("orders"),
            F.sum("units").cast("double").alias("value"),
        )
        .select("window_start", "window_end", "customer_id", "orders", "value")
    )


def _flat(counted: DataFrame, key: str) -> DataFrame:
    return counted.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        key,
        "orders",
        "value",
    )
