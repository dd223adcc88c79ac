"""Recent activity kept up to date by streaming aggregates, and the live overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.plans.overlay import activity_measures, customer_overlay, seller_overlay
from souk.sources.store import Store
from souk.streaming.changes import event_stream, latest_rows, run


def customer_activity_stream(events: DataFrame) -> DataFrame:
    return events.groupBy("customer_id").agg(*activity_measures())


def seller_activity_stream(events: DataFrame) -> DataFrame:
    return events.groupBy("seller_id").agg(*activity_measures())


def seller_reach_stream(events: DataFrame) -> DataFrame:
    """Distinct customers per seller: first sight of a pair, then a count.

    A streaming aggregate cannot count distinct values; remembering the pairs
    is exact, and the state is keyed by pair, so a busy seller is spread out.
    """
    pairs = events.select("seller_id", "customer_id").dropDuplicates(["seller_id", "customer_id"])
    return pairs.groupBy("seller_id").agg(F.count("*").alias("recent_unique_customers"))


class ActivityJobs:
    """The three activity queries over one landing folder."""

    def __init__(
        self, spark: SparkSession, landing: str, store: Store, files_per_batch: int | None = None
    ):
        self.spark, self.landing, self.store = spark, landing, store
        self.files_per_batch = files_per_batch

    def _update(self, make, name: str, every: str):
        stream = make(event_stream(self.spark, self.landing, self.files_per_batch))
        sink = lambda batch, epoch: self.store.append(name, batch, epoch)
        return run(stream, sink, self.store.path("_checkpoints", name), "update", every, (self.store, name))

    def run_customers(self, every: str = "available"):
        return self._update(customer_activity_stream, "customer_activity", every)

    def run_sellers(self, every: str = "available"):
        self._update(seller_reach_stream, "seller_reach", every)
        return self._update(seller_activity_stream, "seller_activity", every)

    def customers(self) -> DataFrame:
        return latest_rows(self.store, "customer_activity", ["customer_id"])

    def sellers(self) -> DataFrame:
        reach = latest_rows(self.store, "seller_reach", ["seller_id"])
        return latest_rows(self.store, "seller_activity", ["seller_id"]).join(reach, "seller_id")

    def refresh_live(
        self, customer_forecast: DataFrame, seller_forecast: DataFrame, now: str
    ) -> tuple[DataFrame, DataFrame]:
        """Re-score both forecasts with the activity seen so far, as new versions."""
        live_customers = customer_overlay(customer_forecast, self.customers(), now)
        live_sellers = seller_overlay(seller_forecast, self.sellers(), now)
        return (
            self.store.replace("customer_live", live_customers),
            self.store.replace("seller_live", live_sellers),
        )
