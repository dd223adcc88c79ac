"""Bucketed tables, mergeable states, refresh by change, the pruned ledger and live buckets."""

import os
import re

import pytest
from pyspark.sql import functions as F

from souk.engine import engine_for
from souk.operators.mergeable import Bits, Cells, Measures, amount, known, least, most, rows_with, total
from souk.plans import gold_customer, gold_seller, incremental, merge
from souk.plans.incremental import Incremental
from souk.sources import schemas
from souk.sources.buckets import Bucketed, touched
from tests.conftest import SMALL
from tests.helpers import as_set


def files(folder):
    """Data files below a folder, by bucket, with what tells a rewritten one apart."""
    out = {}
    for path, _, names in os.walk(folder):
        for n in names:
            if n.startswith("part-"):
                bucket = re.search(r"_bucket=(\d+)", path)
                out.setdefault(int(bucket[1]), set()).add((n, os.stat(f"{path}/{n}").st_mtime_ns))
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def opened(df):
    """Files that rows of a scan come from."""
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def pruned(df):
    return re.search(r"PartitionFilters: \[[^\]]*_bucket", plan(df))


# -- buckets -------------------------------------------------------------------


def test_buckets_are_replaced_alone(spark, store):
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    table = Bucketed(store, "t", "k", rows.schema, 8)
    table.write(rows)
    before = files(table.path)
    only = touched(spark.createDataFrame([(5,)], "k long"), "k", 8)
    for _ in range(2):  # the second time it changes nothing
        table.replace(table.read(only).withColumn("v", F.when(F.col("k") == 5, 1).otherwise(F.col("v"))), "run")
        assert as_set(table.read()) == sorted(((k, int(k == 5)) for k in range(200)), key=repr)
    after = files(table.path)
    assert len(only) == 1 and {b for b in before if before[b] != after[b]} == set(only)


def test_lookup_opens_one_bucket(spark, store):
    rows = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    table = Bucketed(store, "t", "k", rows.schema, 16)
    table.write(rows)
    found = table.lookup(77)
    assert as_set(found) == [(77, 154)]
    assert len(opened(found)) == 1 < len(opened(table.read()))
    assert pruned(found) and "EqualTo(k,77)" in plan(found)


def test_batches_nulls_and_empty(spark, store):
    rows = spark.createDataFrame([(None, 1), (3, 2)], "k long, v int")
    table = Bucketed(store, "t", "k", rows.schema, 4)
    assert as_set(table.read_batches()) == []
    table.append(rows, 0)
    table.append(rows.where("k = 3"), 1)
    table.append(rows.where("k = 3"), 1)
    table.append(rows.where("false"), 2)
    assert as_set(table.read_batches()) == as_set(rows.unionByName(rows.where("k = 3")))
    assert as_set(table.read_batches(without=0)) == [(3, 2)]
    assert as_set(table.read_batches(touched(rows.where("k IS NULL"), "k", 4)).where("k IS NULL")) == [(None, 1)]


# -- states --------------------------------------------------------------------

ROWS = [(1, "a", 10, 0.1), (1, "a", 70_000, 0.2), (1, None, 10, None), (2, "b", -5, 0.3), (2, "a", None, 1e9), (None, "b", 40_000, 0.7)]


@pytest.mark.parametrize("cut", [[], [3], [1, 2, 4]])
def test_states_of_batches_merge_to_the_state_of_all(spark, cut):
    table = spark.createDataFrame(ROWS, "k long, c string, i long, x double")
    edges = [0, *cut, len(ROWS)]
    batches = [spark.createDataFrame(ROWS[a:b], table.schema) for a, b in zip(edges, edges[1:])]
    measures = Measures("k", {"n": rows_with(F.lit(True)), "x": amount("x"), "xn": known("x"), "i": total("i"), "lo": least("i"), "hi": most("i")})
    for state in (measures, Cells("k", ["c"]), Cells("k", ["c"], null_is_value=True), Bits("k", ["i"])):
        parts = [state.start(b) for b in batches]
        merged = parts[0]
        for p in parts[1:]:
            merged = state.merged(merged.unionByName(p))  # again and again: types stay
        assert merged.dtypes == state.start(table).dtypes
        assert as_set(state.merged(merged)) == as_set(state.start(table))


def test_bits_count_exactly_without_expand(spark):
    rows = spark.range(0, 5_000).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 90_001 - 20_000).alias("a"), (F.col("id") % 11).alias("b"))
    bits = Bits("k", ["a", "b"])
    halves = [bits.start(rows.where(f"a % 2 {op} 0")) for op in ("=", "<>")]
    found = bits.read(bits.merged(halves[0].unionByName(halves[1])), {"na": "a", "nb": "b"})
    assert as_set(found) == as_set(rows.groupBy("k").agg(F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb")))
    assert "Expand" not in plan(found)


def test_facts_of_states_equal_those_of_orders(spark):
    e = engine_for(spark, SMALL)
    orders = e.table("orders")
    states = incremental.customers().start(orders)
    assert as_set(incremental.customer_facts(states)) == as_set(gold_customer.customer_order_facts(orders))
    sold = e.table("seller_orders")
    want = gold_seller.seller_order_metrics(sold).join(gold_seller.seller_top_values(sold), "seller_id")
    got = incremental.seller_facts(incremental.sellers().start(sold))
    assert as_set(got.select(*want.columns)) == as_set(want)


def test_seller_states_grow_with_orders_however_far_apart_their_customers_are(spark):
    rows = engine_for(spark, SMALL).table("seller_orders").limit(200)
    far = rows.withColumn("customer_id", F.col("customer_id") * 100_000)
    states = incremental.sellers().start(far)
    wide = [f.name for s in states.values() for f in s.schema.fields if f.dataType.typeName() == "binary"]
    assert not wide  # a bitmap takes 4 kB for each range of 32,768 ids
    assert states["cells"].where("dim = 'customer_id'").count() == far.select("seller_id", "customer_id").distinct().count()


# -- refresh -------------------------------------------------------------------


def test_a_batch_touches_its_buckets_only(spark, store):
    e = engine_for(spark, SMALL)
    job = Incremental(store, e.table("customers"), e.as_of, e.now, buckets=8)
    job.start(e.table("orders"), e.table("customer_seller_mapping"), {n: e.table(n) for n in (*Incremental.MARTS, "rfm_segments")})
    one = e.table("orders").where("customer_id IS NOT NULL").orderBy("order_id").limit(1)
    order = one.withColumn("order_id", F.lit(-1).cast("bigint"))
    link = e.table("customer_seller_mapping").limit(1).withColumns({"order_id": F.lit(-1).cast("bigint"), "customer_id": F.lit(order.first().customer_id)})
    before = {n: files(job.tables[n].path) for n in Incremental.MARTS}
    replaced = job.absorb(order, link, 1)
    assert len(replaced["gold_customer_360"]) == len(replaced["gold_seller_360"]) == 1
    for name in Incremental.MARTS:
        after = files(job.tables[name].path)
        assert {b for b in after if after[b] != before[name].get(b)} == set(replaced[name])
    state = job._states("customer", replaced["gold_customer_360"])["measures"]
    assert pruned(state)
    assert len(opened(state)) < len(opened(job.tables["state_customer_measures"].read_batches()))
    gold = job.mart("gold_customer_360")
    key = order.first().customer_id
    assert gold.where(F.col("customer_id") == key).first().total_orders == e.table("gold_customer_360").where(F.col("customer_id") == key).first().total_orders + 1
    assert as_set(gold.where(F.col("customer_id") != key)) == as_set(e.table("gold_customer_360").where(F.col("customer_id") != key))
    nothing = job.absorb(order.where("false"), link.where("false"), 2)
    assert nothing == {}


# -- ledger and live marts --------------------------------------------------------


def test_ledger_reads_the_batch_buckets_only(spark, store):
    ids = spark.range(1_000).select(F.col("id").alias("event_id"))
    ledger = merge.ledger_of(store)
    ledger.append(ids, 0)
    batch = spark.createDataFrame([(5,), (2_000,)], "event_id long")
    seen = ledger.read_batches(touched(batch, "event_id", ledger.buckets), without=1)
    assert pruned(seen)
    assert len(opened(seen)) <= 2 < len(opened(ledger.read_batches()))
    assert as_set(merge.unmerged(batch, seen.join(batch, "event_id", "left_semi"))) == [(2_000,)]
    assert as_set(store.read("realtime_events_merged", schemas.EVENT_LEDGER)) == as_set(ids)


def test_live_buckets_of_unchanged_keys_keep_their_files(spark, store):
    from souk.plans.overlay import customer_overlay
    from souk.streaming.live import LiveMart

    e = engine_for(spark, SMALL)
    activity, forecast = e.table("customer_recent_activity"), e.table("forecast_customer_outlook")
    mart = LiveMart(store, "live", "customer_id", customer_overlay, e.now, 8)
    mart.start(forecast, activity)
    before = files(mart.tables["live"].path)
    some = activity.orderBy("customer_id").limit(1)
    at = mart.update(some, 0, 0)
    after = files(mart.tables["live"].path)
    assert len(at) == 1 and {b for b in after if after[b] != before[b]} == set(at)
    mart.update(activity.where("customer_id % 2 = 0"), 0, 1)
    mart.update(activity.where("customer_id % 2 = 1"), 0, 2)
    mart.update(activity.where("customer_id % 2 = 1"), 0, 2)
    assert as_set(mart.read()) == as_set(customer_overlay(forecast, activity, e.now))
