"""Streaming write-back of order events into the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk.plans.merge import highest_id, merge_epoch
from souk.sources.store import Store
from souk.streaming.changes import event_stream, run


def run_writeback(
    spark: SparkSession,
    landing: str,
    store: Store,
    base_orders: DataFrame,
    customers: DataFrame,
    every: str = "available",
    files_per_batch: int | None = None,
    checkpoint: str = "writeback",
):
    """Merge new events, one epoch per micro-batch, with its own offsets.

    An event is merged once, even if the checkpoint is lost and all are read again.
    """
    last = highest_id(base_orders)
    return run(
        event_stream(spark, landing, files_per_batch),
        lambda batch, epoch: merge_epoch(store, batch, last, customers, epoch),
        store.path("_checkpoints", checkpoint),
        every=every,
        into=(store, "realtime_events_merged"),
    )
