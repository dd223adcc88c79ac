"""SQL over views and table functions, JSON by path, sketches by batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from souk.engine import engine_for
from souk.sources import paths
from souk.sources.schemas import ORDER_EVENTS
from souk.sqlviews import FUNCTIONS, ask, attach
from souk.streaming.reach import folded, reach, run_reach, sketched
from tests.conftest import SMALL
from tests.helpers import plan_text, typed


@pytest.fixture(scope="module")
def engine(spark):
    return engine_for(spark, SMALL)


def test_arguments_reach_the_scan(engine):
    for call, views in (("customer_profile(:id)", ["customers"]), ("customer_recent_orders(:id, 3)", ["orders"])):
        plan = plan_text(ask(engine, f"SELECT * FROM {call}", views, id=7))
        assert "PushedFilters: [IsNotNull(customer_id), EqualTo(customer_id,7)]" in plan


def test_limits_become_heaps(engine):
    plan = plan_text(ask(engine, "SELECT * FROM sellers_at_risk(:level, 5)", ["forecast_seller_outlook"], level="ALL"))
    assert "TakeOrderedAndProject(limit=5" in plan


def test_values_are_bound(engine):
    text = "SELECT count(*) AS n FROM customers_at_risk(:level)"
    assert ask(engine, text, ["forecast_customer_outlook"], level="HIGH' OR 'a' = 'a").first().n == 0
    assert ask(engine, "SELECT * FROM customer_profile(:id)", ["customers"], id=None).collect() == []


def test_defaults_and_named_arguments(engine):
    attach(engine, ["forecast_customer_outlook"])
    spark = engine.spark
    assert spark.sql("SELECT * FROM customers_at_risk()").collect() == spark.sql("SELECT * FROM customers_at_risk(wanted => 'ALL', most => 50)").collect()
    assert spark.sql("SELECT * FROM customers_at_risk('ALL', 0)").collect() == []


def test_only_functions_over_the_named_views(engine):
    assert attach(engine, ["customers"]) == ["customer_profile"]
    assert attach(engine, []) == []
    assert {f[0] for f in FUNCTIONS} == set(attach(engine))


def test_joined_to_a_table(engine):
    """A function's argument may come from the row it is joined to."""
    text = "SELECT c.customer_id, p.name FROM customers c, LATERAL customer_profile(c.customer_id) p WHERE c.customer_id < 5"
    assert [r.customer_id for r in ask(engine, text, ["customers"]).orderBy("customer_id").collect()] == [0, 1, 2, 3, 4]


def test_clock(engine):
    attach(engine, [])
    assert str(engine.spark.sql("SELECT souk_now").first()[0])[:19] == engine.now[:19]


def test_json_paths(spark):
    texts = ['[{"a": {"b": [1, {"c": "x"}]}, "n": 1}, null, 5]', '{"a": 3, "n": "7"}', '{"n": "word"}', "{ no", "[]", "", None, '{"n": 1e400}']
    items = paths.json_items(spark.createDataFrame([(t,) for t in texts], "body string"), "body")
    found = paths.fields(items, c=("$.a.b[1].c", "string"), n=("$.n", "bigint"), a=("$.a", "int"))
    rows = sorted((tuple(r) for r in found.collect()), key=repr)
    assert rows.count((None, None, None)) >= 3  # the null, the bare number and the word
    assert ("x", 1, None) in rows and (None, 7, 3) in rows
    assert paths.json_items(spark.createDataFrame([], "body string"), "body").count() == 0


def _events(spark, pairs):
    at = dt.datetime(2024, 1, 1)
    return typed(spark, ORDER_EVENTS, [{"event_id": n, "seller_id": s, "customer_id": c, "event_timestamp": at} for n, (s, c) in enumerate(pairs)])


def test_sketches_merge_over_batches(spark, store, tmp_path):
    """Ten batches of overlapping customers: estimates within four standard errors, sketches no larger than the first's bound."""
    landing = str(tmp_path / "landing")
    for n in range(10):
        _events(spark, [(s, c) for s in (1, 2) for c in range(n * 300, n * 300 + 600 * s)]).coalesce(1).write.mode("append").parquet(landing)
    run_reach(spark, landing, store, files_per_batch=1)
    exact = {1: 9 * 300 + 600, 2: 9 * 300 + 1200}
    for r in reach(store).collect():
        assert abs(r.recent_unique_customers - exact[r.seller_id]) <= 4 * 1.04 / 64 * exact[r.seller_id]
    assert store.read("seller_reach_sketches").count() == 20
    sizes = [r.n for r in folded(store).select(F.length("sketch").alias("n")).collect()]
    assert len(sizes) == 2 and max(sizes) <= (1 << 12) + 100


def test_sketches_of_nulls_and_repeats(spark):
    rows = sketched(_events(spark, [(1, None), (2, 5), (2, 5), (None, 5)])).select("seller_id", F.hll_sketch_estimate("sketch").alias("n")).collect()
    assert {r.seller_id: r.n for r in rows} == {1: 0, 2: 1, None: 1}
