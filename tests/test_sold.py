"""Orders with their seller, and labels of sellers that need no more than plain measures of them."""

import pytest
from pyspark.sql import functions as F

from souk.engine import Engine
from souk.plans import enrichment, gold_seller
from souk.registry import QUERIES
from souk.sources import schemas
from souk.sources.store import Store
from souk.sources.testdata import TestData
from tests.helpers import as_set, typed
from tests.test_marts import CUSTOMERS, ORDERS, SELLERS


class Own:
    """Base tables of which the mapping is not given."""

    def __init__(self, spark, orders):
        people = [*CUSTOMERS, dict(customer_id=None)]
        data = {"customers": people, "orders": orders, "sellers": SELLERS}
        self.data = {n: typed(spark, schemas.BASE_TABLES[n], rows) for n, rows in data.items()}

    def in_place(self, name):
        return name in self.data

    def __getattr__(self, name):
        if name in self.__dict__.get("data", {}):
            return lambda: self.data[name]
        raise AttributeError(name)


STRAY = [ORDERS[0] | {"order_id": None}, ORDERS[0] | {"order_id": 11, "customer_id": None}, ORDERS[0] | {"order_id": 12, "customer_id": 99}]


@pytest.mark.parametrize("twice", [False, True])
def test_sellers_of_orders_are_those_of_the_mapping(spark, tmp_path, twice):
    """With null keys, unknown customers and an id that occurs twice; the mapping is joined only for the last."""
    own = Engine(spark, Own(spark, [*ORDERS, *STRAY, *([ORDERS[1] | {"customer_id": 2}] if twice else [])]), Store(spark, str(tmp_path)))
    found = own.plan("seller_orders")
    assert own.store.exists("customer_seller_mapping") is twice
    joined = gold_seller.seller_orders(own.table("orders"), own.table("customer_seller_mapping"))
    assert found.schema == joined.schema and as_set(found) == as_set(joined)
    assert found.count() == (7 if twice else 4)


def test_orders_of_sellers_are_not_shuffled_by_order(spark, small, tmp_path):
    own = Engine(spark, TestData(spark, small), Store(spark, str(tmp_path)))
    plan = own.plan("seller_orders")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(order_id" not in plan and not own.store.exists("customer_seller_mapping")


def test_labels_of_sellers_build_no_more_than_they_read(spark, small, tmp_path):
    own = Engine(spark, TestData(spark, small), Store(spark, str(tmp_path)))
    names = {"ai07_seller_classification": "seller_classification", "ai08_performance_sentiment": "performance_sentiment_score", "ai14_seller_suggested_action": "suggested_action"}
    found = {n: QUERIES[n](own) for n in names} | {"ai13_main_risk_and_strength": QUERIES["ai13_main_risk_and_strength"](own)}
    rows = {n: as_set(df) for n, df in found.items()}
    assert not own.store.exists("gold_seller_360") and not own.store.exists("seller_orders")
    whole = enrichment.seller_enriched(own.table("gold_seller_360"), own.now)
    for n, df in found.items():
        assert rows[n] == as_set(whole.select(*df.columns)) == as_set(QUERIES[n](own))  # the last from the stored mart
    assert len({r[1] for r in rows["ai14_seller_suggested_action"]}) > 1
    assert whole.where(F.col("total_orders_actual").isNotNull()).count() > 0


def test_orders_travel_without_what_they_are_made_of(spark, small):
    """Lines go to their order without columns that no one reads, and orders to their parts and customers as they are stored."""
    plan = TestData(spark, small).narrow("orders")._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" in plan and "l_tax" not in plan and "l_shipdate" not in plan
    moved = [line for line in plan.splitlines() if "rebalance" in line.lower() or "Exchange" in line]
    assert any("hashpartitioning(customer_id" in line for line in moved)
    assert not any("hashpartitioning(o_custkey" in line for line in moved)


def test_customers_of_sellers_need_no_mapping_where_sellers_took_turns(spark, tmp_path):
    """Orders without id, customer or a known one, and written-back orders, whose sellers the mapping alone tells."""
    own = Engine(spark, Own(spark, [*ORDERS, *STRAY]), Store(spark, str(tmp_path)))
    found = own.table("gold_seller_360")
    assert not own.store.exists("customer_seller_mapping")
    served = gold_seller.seller_customer_metrics(own.table("customers"), own.plan("customer_seller_mapping"))
    served = served.where("seller_id IS NOT NULL")
    assert served.count() > 0
    assert as_set(found.where("total_customers_served IS NOT NULL").select(*served.columns)) == as_set(served)
    one = typed(spark, schemas.ORDERS, [ORDERS[0] | {"order_id": 77}])
    link = one.select("customer_id", "order_id", "product_id", "category", F.lit(1).cast("long").alias("seller_id"))
    own.add_orders(one, link)
    assert as_set(own.seller_links()) == as_set(own.table("customer_seller_mapping").select("seller_id", "customer_id"))
    assert own.seller_links().count() == own.plan("seller_orders").count() + 1  # the order without id
