"""Distinct customers of a seller in bounded state: mergeable sketches by batch.

The exact way (``seller_reach_stream``) remembers every pair for ever. Here a
batch is folded into one HyperLogLog sketch for each seller and appended; no
state is kept between batches, a sketch has at most 2 ^ precision bytes, and
sketches of any batches merge. A batch that runs again writes its folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.sources.store import Store
from souk.streaming.changes import event_stream, run

PRECISION = 12  # registers are 2 ^ 12: a relative standard error of 1.04 / sqrt(2 ^ 12), 1.6 %
NAME = "seller_reach_sketches"


def sketched(events: DataFrame, precision: int = PRECISION) -> DataFrame:
    """seller_id, sketch: customers without a value count for nothing."""
    return events.groupBy("seller_id").agg(F.hll_sketch_agg("customer_id", precision).alias("sketch"))


def merged(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("seller_id").agg(F.hll_union_agg("sketch").alias("sketch"))


def run_reach(spark: SparkSession, landing: str, store: Store, files_per_batch: int | None = None, every: str = "available"):
    sink = lambda batch, epoch: store.append(NAME, sketched(batch), epoch)
    return run(event_stream(spark, landing, files_per_batch), sink, store.path("_checkpoints", NAME), every=every)


def reach(store: Store) -> DataFrame:
    """seller_id, recent_unique_customers (an estimate) over all batches so far."""
    return merged(store.read(NAME)).select("seller_id", F.hll_sketch_estimate("sketch").alias("recent_unique_customers"))


def folded(store: Store) -> DataFrame:
    """The sketches of all batches as one new table, a row for each seller."""
    return store.replace(f"{NAME}_folded", merged(store.read(NAME)))
