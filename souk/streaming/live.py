"""Live marts kept up to date per micro-batch: only the buckets of changed keys are re-scored.

Forecast, activity and live rows of a key lie in the same bucket of three
tables.  A batch of changed activity totals replaces those buckets; all other
files stay as they are.  Totals arrive whole (update mode), so a batch that is
run again leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.plans.overlay import customer_overlay, seller_overlay
from souk.sources.buckets import BUCKETS, Bucketed, touched
from souk.sources.store import Store
from souk.streaming.activity import customer_activity_stream, seller_activity_stream, seller_reach_stream
from souk.streaming.changes import event_stream, run

Overlay = Callable[[DataFrame, DataFrame, str], DataFrame]


class LiveMart:
    """One live mart over a forecast and the totals of one or more streams."""

    def __init__(self, store: Store, name: str, key: str, overlay: Overlay, now: str, buckets: int = BUCKETS):
        self.store, self.name, self.key = store, name, key
        self.overlay, self.now, self.buckets = overlay, now, buckets
        self.tables: dict[str, Bucketed] = {}

    def start(self, forecast: DataFrame, *totals: DataFrame) -> None:
        """All rows of the forecast, and no activity yet; ``totals`` show the streams' columns."""
        none = [t.where("false") for t in totals]
        self._create("forecast", forecast)
        for n, rows in enumerate(none):
            self._create(f"totals-{n}", rows)
        self.streams = len(none)
        self._create("live", self._scored(None))

    def _create(self, part: str, rows: DataFrame) -> None:
        table = Bucketed(self.store, f"{self.name}/{part}", self.key, rows.schema, self.buckets)
        table.write(rows)
        self.tables[part] = table

    def _scored(self, only: list[int] | None) -> DataFrame:
        parts = [self.tables[f"totals-{n}"].read(only) for n in range(self.streams)]
        activity = parts[0]
        for more in parts[1:]:
            activity = activity.join(more, self.key)
        return self.overlay(self.tables["forecast"].read(only), activity, self.now)

    def update(self, changed: DataFrame, stream: int, epoch: int) -> list[int]:
        """Takes in one stream's changed totals; returns the buckets that were replaced."""
        totals, at = self.tables[f"totals-{stream}"], touched(changed, self.key, self.buckets)
        old = totals.read(at).join(changed.select(self.key), self.key, "left_anti")
        batch = f"{stream}-{epoch}"
        totals.replace(old.unionByName(changed.select(*old.columns)), batch)
        self.tables["live"].replace(self._scored(at), batch)
        return at

    def read(self) -> DataFrame:
        return self.tables["live"].read()


def run_live_customers(spark: SparkSession, landing: str, store: Store, forecast: DataFrame, now: str,
                       files_per_batch: int | None = None, buckets: int = BUCKETS, every: str = "available") -> LiveMart:
    mart = LiveMart(store, "live_customers", "customer_id", customer_overlay, now, buckets)
    totals = customer_activity_stream(event_stream(spark, landing, files_per_batch))
    mart.start(forecast, spark.createDataFrame([], totals.schema))
    run(totals, lambda batch, epoch: mart.update(batch, 0, epoch), store.path("_checkpoints", mart.name), "update", every)
    return mart


def run_live_sellers(spark: SparkSession, landing: str, store: Store, forecast: DataFrame, now: str,
                     files_per_batch: int | None = None, buckets: int = BUCKETS, every: str = "available") -> LiveMart:
    """Sellers have two streams: totals of their events, and how many customers they reach."""
    mart = LiveMart(store, "live_sellers", "seller_id", seller_overlay, now, buckets)
    streams = [make(event_stream(spark, landing, files_per_batch)) for make in (seller_activity_stream, seller_reach_stream)]
    mart.start(forecast, *[spark.createDataFrame([], s.schema) for s in streams])
    for n, totals in enumerate(streams):
        run(totals, lambda batch, epoch, n=n: mart.update(batch, n, epoch), store.path("_checkpoints", f"{mart.name}-{n}"), "update", every)
    return mart
