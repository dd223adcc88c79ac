"""Shapes of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from souk.engine import engine_for
from souk.registry import QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def engine(spark):
    return engine_for(spark, SMALL)


def test_own_base_tables_give_the_same_marts(spark, engine, tmp_path):
    from souk.engine import Engine
    from souk.sources.store import Store
    from souk.sources.tables import ModelTables
    from tests.helpers import as_set

    for name in ("customers", "orders", "marketing_interactions", "sellers",
                 "customer_seller_mapping", "realtime_order_events"):
        engine.table(name).write.parquet(str(tmp_path / name))
    own = Engine(spark, ModelTables(spark, str(tmp_path)), Store(spark, str(tmp_path / "store")))
    for name in ("gold_customer_360", "gold_seller_360"):
        assert as_set(own.plan(name)) == as_set(engine.plan(name))
    assert not own.store.exists("customers") and not own.store.exists("orders")  # read where they are

    built = as_set(own.table("gold_seller_360"))
    again = Engine(spark, ModelTables(spark, str(tmp_path)), own.store)
    again.build = None  # a second process on the same store writes nothing
    assert as_set(again.table("gold_seller_360")) == built

    mapping = own.table("customer_seller_mapping")
    one = own.table("orders").limit(1).withColumn("order_id", F.lit(-1).cast("bigint"))
    link = mapping.limit(1).withColumn("order_id", F.lit(-1).cast("bigint"))
    n = own.table("orders").count()
    for _ in range(2):
        own.add_orders(one, link)
        assert own.table("orders").count() == n + 1


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text):
    return re.findall(r"ReadSchema: struct<([^>]*)>", text)


@pytest.mark.parametrize("name", ["customer_order_facts", "gold_customer_360", "seller_orders",
                                  "gold_seller_360", "customer_ai_360", "forecast_customer_outlook",
                                  "inventory_risk", "platform_profiles", "cross_platform_identity"])
def test_marts_never_gather_everything_in_one_task(engine, name):
    assert "SinglePartition" not in physical(engine.plan(name))


def test_wide_measures_stay_in_hash_aggregates(engine):
    text = physical(engine.plan("customer_order_facts"))
    measures = [line for line in text.splitlines() if "sum(" in line and "Aggregate(" in line]
    assert measures and all("HashAggregate" in line for line in measures)


def test_point_lookup_pushes_its_filter_and_reads_three_columns(engine):
    text = physical(QUERIES["flt07_point_lookup"](engine))
    assert "EqualTo(customer_id,7)" in text and len(scans(text)[0].split(",")) == 3


def test_reports_read_only_their_columns(engine):
    text = physical(QUERIES["rpt02_customers_by_tier"](engine))
    assert scans(text) == ["loyalty_tier:string,customer_lifetime_value:double"]


def test_alert_board_reads_each_table_once(engine):
    text = physical(QUERIES["rpt20_alert_board"](engine))
    # sellers, two live marts, seller forecast, inventory (twice: rows and groups), alerts
    assert len(scans(text)) == 7


def test_top_k_has_no_global_sort(engine):
    text = physical(QUERIES["rpt03_top_customers"](engine))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_activity_join_and_facts_share_their_partitioning(engine):
    text = physical(engine.plan("customer_order_facts"))
    joins = text.count("SortMergeJoin") + text.count("ShuffledHashJoin") + text.count("BroadcastHashJoin")
    assert joins == 2
    # one shuffle per aggregate step, none for the joins
    assert text.count("Exchange hashpartitioning") == 5


def test_hot_keys_are_found_without_shuffling_the_facts_by_them(spark):
    """Static plan with the size-based broadcast off: facts are exchanged once, by key and sub-key."""
    from souk.operators.joins import split_join

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("wide"))
        dim = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
        out = split_join(facts, dim, "k", spread="wide", hot_rows=20)
        text = physical(out)
        assert out.count() == 100 and out.where("v <> 10 * k").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("BroadcastHashJoin") == 2 and text.count("SortMergeJoin") == 1
    raw = [x for x in re.findall(r"hashpartitioning\(([^)]*)\)", text) if "_sub" not in x]
    assert len(raw) == text.count("HashAggregate") // 2  # only the counts of the keys


def test_large_base_tables_are_stored_as_narrow_rows(spark, small, tmp_path):
    from souk.engine import Engine
    from souk.sources.store import Store
    from souk.sources.testdata import TestData
    from tests.helpers import as_set

    e = Engine(spark, TestData(spark, small), Store(spark, str(tmp_path / "store")))
    for name in ("orders", "marketing_interactions"):
        source = TestData(spark, small)
        rows = {"orders": source._order_lines, "marketing_interactions": source._interactions}[name]()
        assert as_set(e.table(name)) == as_set(source._map(rows, source._mapping(name)))
        assert not e.store.exists(name)
    read = scans(physical(e.table("orders").select("order_id", "customer_id")))
    assert read == ["order_id:bigint,customer_id:bigint"]

    again = Engine(spark, TestData(spark, small), e.store)
    again.source.narrow = None  # a second process on the same store writes nothing
    assert again.table("orders").count() == e.table("orders").count()


def test_an_engine_over_stored_tables_copies_none(spark, small, tmp_path):
    from souk.engine import Engine
    from souk.registry import _Stored
    from souk.sources.store import Store

    e = engine_for(spark, small)
    fresh = Engine(spark, _Stored(e), Store(spark, str(tmp_path / "store")), e.as_of, e.now)
    for name in ("customers", "orders", "sellers", "marketing_interactions", "realtime_order_events"):
        assert fresh.table(name).count() == e.table(name).count()
        assert not fresh.store.exists(name)


def test_orders_of_sellers_are_stored_narrow_and_together(spark, small, tmp_path):
    """All columns are there, but few are stored; one seller's rows lie together; written-back orders are stored whole."""
    from souk.engine import Engine
    from souk.plans import gold_seller
    from souk.sources.store import Store
    from souk.sources.testdata import TestData

    own = Engine(spark, TestData(spark, small), Store(spark, str(tmp_path)))
    shown, plain = own.table("seller_orders"), own.plan("seller_orders")
    assert shown.schema == plain.schema and shown.exceptAll(plain).isEmpty() and plain.exceptAll(shown).isEmpty()
    stored = own.store.read("seller_orders")
    assert len(stored.columns) == 12 and "margin" not in stored.columns
    sellers = [r.seller_id for r in stored.select(gold_seller.KEY).collect()]
    runs = 1 + sum(a != b for a, b in zip(sellers, sellers[1:], strict=False))
    assert runs <= len(set(sellers)) * 2
    again = Engine(spark, TestData(spark, small), Store(spark, str(tmp_path)))
    again.build = None  # a second process on the same store writes nothing
    assert again.table("seller_orders").columns == shown.columns
    one = own.table("orders").limit(1).withColumn("order_id", F.lit(-5).cast("bigint"))
    own.add_orders(one, one.select("customer_id", "order_id", "product_id", "category").withColumn("seller_id", F.lit(3).cast("bigint")))
    n = shown.count()
    own.build("seller_orders")
    assert own.table("seller_orders").count() == n + 1 and "margin" in own.store.read("seller_orders").columns
