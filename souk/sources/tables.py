"""Base tables that already have the declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk.sources.schemas import BASE_TABLES
from souk.sources.seller_json import ingest_sellers
from souk.sources.store import typed_read


class ModelTables:
    """A source for ``Engine``: one Parquet folder per base table below ``folder``.

    With ``seller_json`` the sellers come from raw text rows holding JSON
    arrays instead of a table.
    """

    def __init__(self, spark: SparkSession, folder: str, seller_json: str | None = None):
        self.spark, self.folder, self.seller_json = spark, folder.rstrip("/"), seller_json

    def in_place(self, name: str) -> bool:
        """Whether a table is read from its own files; parsed sellers are stored first."""
        return not (name == "sellers" and self.seller_json)

    def _read(self, name: str) -> DataFrame:
        return typed_read(self.spark, f"{self.folder}/{name}", BASE_TABLES[name])

    def customers(self) -> DataFrame:
        return self._read("customers")

    def orders(self) -> DataFrame:
        return self._read("orders")

    def marketing_interactions(self) -> DataFrame:
        return self._read("marketing_interactions")

    def realtime_order_events(self) -> DataFrame:
        return self._read("realtime_order_events")

    def customer_seller_mapping(self) -> DataFrame:
        return self._read("customer_seller_mapping")

    def sellers(self) -> DataFrame:
        if self.seller_json:
            return ingest_sellers(self.spark.read.parquet(self.seller_json))
        return self._read("sellers")
