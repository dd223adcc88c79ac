"""Marts by name: what each is built from, and when it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.plans import (
    enrichment,
    forecast_customer,
    forecast_seller,
    gold_customer,
    gold_seller,
    inventory,
    overlay,
    platforms,
    rfm,
)
from souk.sources.schemas import BASE_TABLES
from souk.operators.joins import not_in
from souk.sources.store import Store, conform, freeing
from souk.sources.testdata import AS_OF, NOW, TestData

# Order of a full refresh: every mart after the marts it reads.
REFRESH_ORDER = [
    "gold_customer_360",
    "seller_orders",
    "gold_seller_360",
    "customer_ai_360",
    "rfm_segments",
    "seller_enriched",
    "forecast_customer_outlook",
    "forecast_seller_outlook",
    "customer_recent_activity",
    "seller_recent_activity",
    "customer_live",
    "seller_live",
]

class Engine:
    """Base tables plus marts over one set of sources.

    A mart is built from other marts and written to the store the first time
    it is asked for; later reports read the written table with only the
    columns and row groups they need.  ``source`` offers the base tables as
    methods: ``ModelTables`` for tables with the declared schemas, ``TestData``
    for the given star-schema tables.
    """

    def __init__(
        self,
        spark: SparkSession,
        source,
        store: Store | None = None,
        as_of: str = AS_OF,
        now: str = NOW,
    ):
        self.spark, self.source = spark, source
        self.store = store or Store(spark)
        self.as_of, self.now = as_of, now
        self._ready: dict[str, DataFrame] = {}
        self._rebuild = False
        self._in_turn = False  # whether seller_orders was built without a mapping

    def table(self, name: str) -> DataFrame:
        """A table: as the source has it, as the store has it, or built and stored now."""
        if name not in self._ready:
            narrow = name in getattr(self.source, "NARROW", ())
            if narrow or self._in_place(name):
                self._ready[name] = self._mapped(name) if narrow else self.plan(name)
                if self.store.exists(name):  # written-back orders
                    self._ready[name] = self._ready[name].unionByName(self.store.read(name, BASE_TABLES[name]))
            elif self.store.exists(name) and (name in BASE_TABLES or not self._rebuild):
                self._ready[name] = self._shown(name, self.store.read(name))
            else:
                self.build(name)
        return self._ready[name]

    def build(self, name: str) -> DataFrame:
        """Works a table out and stores it as a new version."""
        rows = self.order_rows() if name == "seller_orders" else None
        if rows is not None:
            # One seller's rows lie together, so its measures combine before they are shuffled.
            stored = self.store.replace(name, self._with_seller(rows), cluster_by=gold_seller.KEY)
        else:
            stored = self.store.replace(name, self.plan(name))
        self._ready[name] = self._shown(name, stored)
        return self._ready[name]

    def order_rows(self) -> DataFrame | None:
        """Orders as they are stored before most columns are mapped; None where they are stored whole, as written-back ones are."""
        if self.store.exists("orders"):
            return None
        if "orders" in getattr(self.source, "NARROW", ()):
            self.table("orders")
            return self.store.read("_narrow/orders")
        offers = getattr(self.source, "order_rows", None)
        return offers() if offers else None

    def _shown(self, name: str, stored: DataFrame) -> DataFrame:
        """A stored table with all its columns: orders of sellers may be stored as narrow as the orders are."""
        if name != "seller_orders" or "order_date" in stored.columns:
            return stored
        return self.source.mapped("orders", stored, gold_seller.KEY).select("order_id", *gold_seller.SELLER_ORDER_COLUMNS[1:], gold_seller.KEY)

    def _in_place(self, name: str) -> bool:
        """Whether the source offers a base table in files of its own, which need no copy."""
        offers = getattr(self.source, "in_place", None)
        return name in BASE_TABLES and offers is not None and offers(name)

    def _mapped(self, name: str) -> DataFrame:
        """A base table over the narrow rows of its source, which alone are stored; its columns are a projection of them."""
        rows = f"_narrow/{name}"
        known = self.store.exists(rows)
        return self.source.mapped(name, self.store.read(rows) if known else self.store.replace(rows, self.source.narrow(name)))

    def plan(self, name: str) -> DataFrame:
        """The query that defines a table, reading stored inputs."""
        return getattr(self, f"_{name}")()

    def refresh(self) -> dict[str, DataFrame]:
        """Rebuild every mart in dependency order from the current base tables."""
        self._ready = {n: df for n, df in self._ready.items() if n in BASE_TABLES}
        self._rebuild = True  # what is stored from before is not used any more
        return {name: self.build(name) for name in REFRESH_ORDER}

    def absorb(self, merged_orders: DataFrame, merged_mapping: DataFrame) -> dict[str, DataFrame]:
        """Add written-back orders to the base tables, then refresh."""
        self.add_orders(merged_orders, merged_mapping)
        return self.refresh()

    def add_orders(self, merged_orders: DataFrame, merged_mapping: DataFrame) -> None:
        """Append written-back orders and their mapping as a batch; orders already there are left out."""
        added = {"orders": merged_orders, "customer_seller_mapping": merged_mapping}
        self._in_turn = False
        for name, rows in added.items():
            schema = BASE_TABLES[name]
            new = conform(not_in(rows, self.table(name), "order_id"), schema)
            epoch = max(self.store.epochs(name), default=-1) + 1
            self.store.append(name, new.sortWithinPartitions("customer_id"), epoch)
            del self._ready[name]

    # -- base tables ------------------------------------------------------
    def _customers(self):
        return self.source.customers()

    def _orders(self):
        return self.source.orders()

    def _sellers(self):
        return self.source.sellers()

    def _marketing_interactions(self):
        return self.source.marketing_interactions()

    def _realtime_order_events(self):
        return self.source.realtime_order_events()

    def _customer_seller_mapping(self):
        if hasattr(self.source, "customer_seller_mapping"):
            return self.source.customer_seller_mapping()
        sellers = self.table("sellers").agg(F.count("*")).scalar()
        return gold_seller.customer_seller_mapping(
            self.table("orders"), self.table("customers"), sellers
        )

    # -- customer side ----------------------------------------------------
    def _customer_order_facts(self):
        return gold_customer.customer_order_facts(self.table("orders"))

    def _customer_marketing_facts(self):
        return gold_customer.customer_marketing_facts(self.table("marketing_interactions"))

    def _gold_customer_360(self):
        # The facts are planned, not stored: their aggregates already leave
        # them partitioned by customer, which the joins reuse.
        return gold_customer.gold_customer_360(
            self.table("customers"),
            self.plan("customer_order_facts"),
            self.plan("customer_marketing_facts"),
            self.now,
        )

    def _customer_ai_360(self):
        return enrichment.customer_ai_360(self.table("gold_customer_360"), self.now)

    def _rfm_segments(self):
        base = rfm.rfm_base(self.table("gold_customer_360"), self.as_of)
        return rfm.rfm_segments(rfm.rfm_scores(base, self.store))

    def _forecast_customer_outlook(self):
        return forecast_customer.forecast_customer_outlook(
            self.table("customer_ai_360"), self.table("rfm_segments"), self.as_of, self.now
        )

    # -- seller side ------------------------------------------------------
    def _seller_orders(self):
        return self._with_seller(self.table("orders").select(gold_seller.SELLER_ORDER_COLUMNS))

    def _with_seller(self, orders: DataFrame) -> DataFrame:
        """Orders with their seller, whose turn it is by order id; joined to a mapping only where that may say more.

        That is one which is given or has written-back rows, and orders with an id that occurs twice.
        """
        more = hasattr(self.source, "customer_seller_mapping") or self.store.epochs("customer_seller_mapping") or self.store.epochs("orders")
        known = orders.where(F.col("order_id").isNotNull())
        with freeing(self.spark):
            self._in_turn = not (more or known.groupBy("order_id").agg(F.count("*").alias("n")).where("n > 1").take(1))
        if not self._in_turn:
            return gold_seller.with_seller(orders, self.table("customer_seller_mapping"))
        return gold_seller.in_turn(known, self.table("customers"), F.lit(self.table("sellers").count()))

    def seller_links(self) -> DataFrame:
        """Seller and customer of each mapped order: of the orders with their seller, where these took turns, else of the mapping.

        The mapping also has orders without an id, which have no seller.
        """
        sold = self.table("seller_orders")
        links = sold if self._in_turn else self.table("customer_seller_mapping")
        return links.select(gold_seller.KEY, "customer_id")

    def _gold_seller_360(self):
        sold = self.table("seller_orders")
        return gold_seller.gold_seller_360(
            self.table("sellers"),
            gold_seller.seller_order_metrics(sold),
            gold_seller.seller_customer_metrics(self.table("customers"), self.seller_links()),
            gold_seller.seller_top_values(sold),
            self.as_of,
            self.now,
        )

    def seller_measures(self) -> DataFrame:
        """Sellers with all that their labels read: the stored seller 360, or else only its plain measures, not stored."""
        if "gold_seller_360" in self._ready:
            return self.table("gold_seller_360")
        sold = self.table("seller_orders") if "seller_orders" in self._ready else self.plan("seller_orders")
        return gold_seller.seller_measures_360(
            self.table("sellers"), gold_seller.seller_order_measures(sold), self.as_of, self.now
        )

    def _seller_enriched(self):
        return enrichment.seller_enriched(self.table("gold_seller_360"), self.now)

    def _forecast_seller_outlook(self):
        return forecast_seller.forecast_seller_outlook(self.table("seller_enriched"), self.now)

    def _order_fact(self):
        return gold_seller.order_fact(
            self.table("orders"),
            self.table("customers"),
            self.table("customer_seller_mapping"),
            self.table("sellers"),
        )

    # -- live -------------------------------------------------------------
    def _customer_recent_activity(self):
        return overlay.customer_recent_activity(self.table("realtime_order_events"))

    def _seller_recent_activity(self):
        return overlay.seller_recent_activity(self.table("realtime_order_events"))

    def _customer_live(self):
        return overlay.customer_overlay(
            self.table("forecast_customer_outlook"),
            self.table("customer_recent_activity"),
            self.now,
        )

    def _seller_live(self):
        return overlay.seller_overlay(
            self.table("forecast_seller_outlook"), self.table("seller_recent_activity"), self.now
        )

    # -- inventory and platforms -------------------------------------------
    def _inventory_risk(self):
        return inventory.inventory_risk(self.table("seller_orders"), self.table("sellers"))

    def _stockout_alerts(self):
        """Alerts of the last run keep their time, and are closed for products that recovered."""
        known = self.store.exists("stockout_alerts")
        before = self.store.read("stockout_alerts") if known else None
        return inventory.stockout_alerts(self.table("inventory_risk"), before, self.now)

    def _platform_profiles(self):
        return platforms.customer_platform_profiles(self.table("orders"))

    def _cross_platform_identity(self):
        return platforms.cross_platform_identity(
            self.table("platform_profiles"), self.table("customers"), self.table("rfm_segments")
        )

    def _cross_platform_marketing(self):
        return platforms.cross_platform_marketing(
            self.table("cross_platform_identity"),
            platforms.platform_switches(self.table("orders"), self.store),
        )


_engines: dict[tuple[str, str], Engine] = {}


def engine_for(spark: SparkSession, folder: str) -> Engine:
    """One engine per application and data folder, so marts are written once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _engines:
        _engines[key] = Engine(spark, TestData(spark, folder))
    return _engines[key]


__all__ = ["Engine", "engine_for", "REFRESH_ORDER"]
