import datetime as dt

import pytest
from pyspark.sql import functions as F

from souk.plans import inventory, merge, overlay, platforms
from souk.sources import schemas
from souk.streaming import changes, windows
from souk.streaming.activity import ActivityJobs
from souk.streaming.writeback import run_writeback
from tests.helpers import as_set, by, frame, typed
from tests.test_marts import CUSTOMERS, ORDERS, order

NOW = "2024-01-31 00:00:00"
T0 = dt.datetime(2024, 1, 30, 12, 0, 0)


def event(i, customer=1, seller=0, value=100.0, at=T0, **more):
    base = dict(event_id=i, event_timestamp=at, customer_id=customer, seller_id=seller,
                order_value=value, category="A", payment_type="COD", is_returned=False,
                is_cancelled=False, customer_rating=4, delivery_time_days=3)
    return base | more


def events(spark, rows):
    return typed(spark, schemas.ORDER_EVENTS, rows)


def many(n=60):
    return [event(i, customer=i % 7, seller=i % 3, value=200.0 + i / 4, at=T0 + dt.timedelta(minutes=17 * i),
                  is_returned=i % 5 == 0, customer_rating=1 + i % 5) for i in range(n)]


FORECAST = [
    dict(customer_id=i, customer_name=f"N{i}", city="c", state="s", persona="p", current_loyalty_tier="gold",
         predicted_loyalty_tier="gold", current_rfm_segment="At Risk", predicted_rfm_segment="At Risk",
         current_churn_risk=0.5, churn_prediction_30d=label, churn_probability_score=score, current_clv=clv,
         projected_clv_90d=clv + 10, revenue_at_risk=1.0, retention_priority="LOW",
         upsell_potential_score=0.1, persona_stability="STABLE", marketing_responsiveness_score=0.1,
         recommended_intervention="X")
    for i, label, score, clv in [
        (1, "HIGH", 0.78, 1000.0), (2, "HIGH", 0.78, 1000.0), (3, "LOW", 0.2, 500.0),
        (4, "LOW", None, 500.0), (5, "VERY HIGH", 0.9, 200000.0)]
]


def live(spark, rows):
    forecast = frame(spark, FORECAST)
    activity = overlay.customer_recent_activity(events(spark, rows))
    return by(overlay.customer_overlay(forecast, activity, NOW), "customer_id")


def test_customer_overlay_recency_edges(spark):
    now = dt.datetime(2024, 1, 31)
    rows = [event(1, 1, at=now - dt.timedelta(hours=1)),
            event(2, 2, at=now - dt.timedelta(hours=1, seconds=1)),
            event(3, 3, at=now - dt.timedelta(hours=6)),
            event(4, 5, at=now - dt.timedelta(hours=6, seconds=1), value=50.0)]
    got = live(spark, rows)
    assert got[1].realtime_churn_score == 0.6 and got[2].realtime_churn_score == 0.65
    assert got[1].realtime_churn_prediction == "HIGH"
    assert got[3].realtime_churn_score == 0.07 and not got[3].prediction_changed
    assert got[5].realtime_churn_score == 0.87 and got[5].realtime_retention_priority == "CRITICAL"
    assert got[5].realtime_clv == 200050.0 and got[5].realtime_projected_clv_90d == 200160.0
    assert got[1].realtime_revenue_at_risk == round(1100 * 0.65, 2)


def test_overlay_without_activity_or_score(spark):
    got = live(spark, [event(1, 99)])
    assert (got[1].realtime_order_count, got[1].realtime_order_value) == (0, 0.0)
    assert got[1].prediction_changed is True  # the change ladder calls 0.78 VERY HIGH
    assert got[4].realtime_churn_score is None and got[4].realtime_churn_prediction == "LOW"
    assert got[4].prediction_changed is False


def test_seller_overlay(spark):
    base = dict(seller_name="s", seller_type="t", seller_category="c", seller_city="x", years_on_platform=1,
                current_seller_tier="gold", predicted_seller_tier="gold", revenue_growth_trend="STABLE",
                current_risk_segment="Low Risk", profit_trajectory="HEALTHY", customer_base_trend="STABLE",
                investment_recommendation="MONITOR", recommended_action="X", sustainability_score=0.5)
    rows = [base | dict(seller_id=i, current_revenue=rev, projected_revenue_90d=1000.0, risk_forecast=label,
                        risk_escalation_probability=e, operational_health_score=h, revenue_at_risk=1.0)
            for i, rev, label, e, h in [(0, 1000.0, "STABLE", 0.25, 90.0), (1, 0.0, "HIGH", 0.6, 1.0)]]
    seen = [event(i, customer=i, seller=0, is_returned=i < 2) for i in range(5)]
    activity = overlay.seller_recent_activity(events(spark, seen))
    a = by(overlay.seller_overlay(frame(spark, rows), activity, NOW), "seller_id")
    x = 0.25 + 40 / 100 * 0.3
    assert a[0].realtime_risk_score == round(x - 0.05 - 0.03, 3)
    assert a[0].realtime_risk_forecast == "ELEVATED" and a[0].prediction_changed
    assert a[0].realtime_ops_health == 90 - 20 + 5 + 3
    assert (a[0].realtime_revenue_lift_pct, a[0].realtime_projected_rev_90d) == (50.0, 7000.0)
    assert a[0].realtime_new_customers == 5
    assert a[0].realtime_revenue_at_risk == round(1500 * (x - 0.05), 2)
    assert (a[1].realtime_revenue_lift_pct, a[1].realtime_ops_health) == (0.0, 1.0)
    assert a[1].prediction_changed is False


# -- write-back -------------------------------------------------------------------


def tables(spark):
    return typed(spark, schemas.ORDERS, ORDERS), typed(spark, schemas.CUSTOMERS, CUSTOMERS)


def merged_state(store):
    return {
        name: as_set(store.read(name, schema))
        for name, schema in [("orders_merged", schemas.ORDERS), ("mapping_merged", schemas.MAPPING),
                             ("realtime_events_merged", schemas.EVENT_LEDGER)]
    }


def test_merge_twice_equals_merge_once(spark, store):
    orders, customers = tables(spark)
    batch = events(spark, [event(5, 1), event(6, 2, at=T0 - dt.timedelta(1)), event(7, 99)])
    merge.merge_epoch(store, batch, 4, customers, 0)
    first = merged_state(store)
    merge.merge_epoch(store, batch, 4, customers, 0)  # the same batch again
    assert merged_state(store) == first
    merge.merge_epoch(store, batch, 4, customers, 1)  # redelivered in a later batch
    assert merged_state(store) == first


def test_merge_numbers_after_the_highest_id(spark, store):
    orders, customers = tables(spark)
    merge.merge_epoch(store, events(spark, [event(5, 1), event(6, 2, at=T0 - dt.timedelta(1))]), 4, customers, 0)
    merge.merge_epoch(store, events(spark, [event(8, 1), event(8, 1)]), 4, customers, 1)
    got = by(store.read("orders_merged", schemas.ORDERS), "order_id")
    assert sorted(got) == [5, 6, 7]
    assert (got[5].customer_id, got[6].customer_id, got[7].customer_id) == (2, 1, 1)
    assert str(got[5].order_date) == "2024-01-29" and got[6].order_time == "12:00:00"
    assert got[6].shipping_city == "c" and got[6].order_status == "Delivered" and got[6].cod_flag


def test_unknown_customers_are_kept_as_rejects(spark, store):
    orders, customers = tables(spark)
    merge.merge_epoch(store, events(spark, [event(7, 99), event(9, 1)]), 4, customers, 0)
    assert [r.event_id for r in store.read("events_rejected").collect()] == [7]
    assert as_set(store.read("realtime_events_merged")) == [(7,), (9,)]
    assert store.read("orders_merged").count() == 1


def test_repeated_ids_and_merged_events_are_left_out(spark, store):
    orders, customers = tables(spark)
    seen = spark.createDataFrame([(3,), (4,), (77,)], schemas.EVENT_LEDGER)
    fresh = merge.unmerged(events(spark, many(40) + many(5)), seen)
    assert len(as_set(fresh, "event_id")) == 38


def test_events_read_again_by_a_new_query_are_merged_once(spark, store):
    orders, customers = tables(spark)
    for rows in (many(40)[:25], many(40)[25:], many(40)):
        n = store.batch_number("realtime_events_merged", f"query-{len(rows)}", 0)
        merge.merge_epoch(store, events(spark, rows), 4, customers, n)
        merge.merge_epoch(store, events(spark, rows), 4, customers, n)
    # the first batch again, after a later one: it leaves out what that one has merged
    merge.merge_epoch(store, events(spark, many(40)), 4, customers, 0)
    ids = [r.order_id for r in store.read("orders_merged").collect()]
    assert len(ids) == len(set(ids)) == store.read("mapping_merged").count()
    assert len(as_set(store.read("realtime_events_merged"))) == store.read("realtime_events_merged").count() == 40


def test_batch_numbers_go_on_after_a_new_checkpoint(spark, store):
    one = spark.range(1)
    for query, epoch, want in (("a", 0, 0), ("a", 1, 1), ("a", 1, 1), ("b", 0, 2), ("b", 0, 2), ("b", 1, 3), ("a", 1, 1)):
        n = store.batch_number("t", query, epoch)
        assert n == want
        store.append("t", one, n)


def test_mapping_by_event_id_where_values_collide(spark, store):
    orders, customers = tables(spark)
    twins = events(spark, [event(1, 1, seller=4), event(2, 1, seller=8)])
    numbered = merge.numbered_events(twins, customers, store, "x")
    full = merge.merged_orders(numbered, merge.max_id(orders))
    assert as_set(merge.mapping_rows(full), "order_id", "seller_id") == [(5, 4), (6, 8)]
    loose = merge.mapping_by_value(merge.order_rows(full), twins, 4)
    assert loose.count() == 4  # each order matches both events


def test_merged_attributes(spark, store):
    orders, customers = tables(spark)
    rows = [event(i, 1, value=16000.0 if i == 0 else 100.0, is_returned=i == 1, is_cancelled=i == 2,
                  delivery_time_days=6) for i in range(40)]
    numbered = merge.numbered_events(events(spark, rows), customers, store, "x")
    got = by(merge.merged_orders(numbered, F.lit(0)), "event_id")
    assert got[0].fraud_flag and not got[3].fraud_flag
    assert got[1].order_status == "Returned" and got[1].refund_amount == 90.0 and got[1].high_rto_risk_flag
    assert got[2].order_status == "Cancelled" and got[2].payment_status == "Refunded"
    assert got[2].cancellation_reason in merge.CANCEL_REASONS and got[2].return_reason is None
    assert all(1 <= r.quantity <= 4 and r.unit_price == round(r.order_value / r.quantity, 2) for r in got.values())
    assert {r.brand for r in got.values()} <= {"BrandA", "BrandB", "BrandC", "BrandD", "BrandE"}


# -- streams ------------------------------------------------------------------------


def land_files(spark, folder, rows, files, start=0):
    size = -(-len(rows) // files)
    for n in range(files):
        part = rows[n * size:(n + 1) * size]
        if part:
            events(spark, part).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("files", [1, 3, 10])
def test_streamed_activity_equals_batch(spark, store, files):
    rows, landing = many(), store.path("landing")
    land_files(spark, landing, rows, files)
    jobs = ActivityJobs(spark, landing, store, files_per_batch=2)
    jobs.run_customers()
    want = overlay.customer_recent_activity(events(spark, rows))
    assert as_set(jobs.customers().select(want.columns)) == as_set(want)
    if files == 3:
        jobs.run_sellers()
        want = overlay.seller_recent_activity(events(spark, rows))
        assert as_set(jobs.sellers().select(want.columns)) == as_set(want)


def test_stream_goes_on_after_a_restart(spark, store):
    """Also folds the updates of the first run, which must not change anything."""
    rows, landing = many(), store.path("landing")
    land_files(spark, landing, rows[:25], 1)
    ActivityJobs(spark, landing, store).run_customers()
    changes.compact(store, "customer_activity", ["customer_id"])
    land_files(spark, landing, rows[25:], 2)
    jobs = ActivityJobs(spark, landing, store)
    jobs.run_customers()
    want = overlay.customer_recent_activity(events(spark, rows))
    assert as_set(jobs.customers().select(want.columns)) == as_set(want)
    changes.compact(store, "customer_activity", ["customer_id"])
    assert as_set(jobs.customers().select(want.columns)) == as_set(want)


def test_standing_query_with_an_interval(spark, store):
    landing, sizes = store.path("landing"), []
    land_files(spark, landing, many(10), 1)
    query = changes.run(changes.event_stream(spark, landing), lambda b, e: sizes.append(b.count()),
                        store.path("_c"), every="1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sizes == [10]


def test_change_stream_reads_each_file_once(spark, store):
    landing, sizes = store.path("landing"), []
    for n in range(3):
        if n < 2:
            land_files(spark, landing, many()[n * 10:n * 10 + 10], 1)
        changes.run(changes.event_stream(spark, landing), lambda b, e: sizes.append(b.count()),
                    store.path("_c"))
    assert sizes == [10, 10]


@pytest.mark.parametrize("files", [1, 3])
def test_streamed_writeback_is_exactly_once(spark, store, files):
    orders, customers = tables(spark)
    rows, landing = many(30), store.path("landing")
    land_files(spark, landing, rows, files)
    land_files(spark, landing, rows[:5], 1)  # delivered twice
    run_writeback(spark, landing, store, orders, customers, files_per_batch=1)
    known = [r for r in rows if r["customer_id"] in (1, 2, 3)]
    ids = [r.order_id for r in store.read("orders_merged", schemas.ORDERS).collect()]
    assert sorted(ids) == list(range(5, 5 + len(known)))
    assert store.read("realtime_events_merged").count() == 30


def test_landing_assigns_ids_and_defaults(spark, store):
    bare = events(spark, [event(None, 1, is_returned=None, at=None), event(None, 2)]).drop("event_id")
    changes.land(bare, store, "l", 0, NOW)
    changes.land(bare, store, "l", 1, NOW)
    changes.land(bare, store, "l", 1, NOW)
    rows = store.read("l", schemas.ORDER_EVENTS).collect()
    assert sorted(r.event_id for r in rows) == [1, 2, 3, 4]
    assert all(r.is_returned is False and r.event_timestamp is not None for r in rows)


def test_has_new_data(spark):
    seen = events(spark, [event(1), event(4)])
    none = spark.createDataFrame([], schemas.EVENT_LEDGER)
    assert changes.has_new_data(seen, none).first().has_new_data
    assert not changes.has_new_data(seen, seen.select("event_id")).first().has_new_data


def closed(df, until):
    return [r for r in as_set(df) if r[1] <= until]


def test_windows_stream_equals_batch_for_closed_windows(spark, store):
    rows, landing = many(), store.path("landing")
    land_files(spark, landing, rows, 1)
    land_files(spark, landing, [event(999, 50, at=T0 + dt.timedelta(days=3))], 1)
    for name, make in (("w", lambda e: windows.windowed_activity(e, "2 hours", "1 hour")),
                       ("s", lambda e: windows.session_activity(e, "1 hour"))):
        stream = make(changes.event_stream(spark, landing))
        changes.run(stream, changes.into_table(store, name), store.path("_c", name))
        batch = make(events(spark, rows))
        assert as_set(store.read(name)) == as_set(batch)


def test_redelivered_events_are_dropped_within_the_watermark(spark, store):
    landing = store.path("landing")
    land_files(spark, landing, many(10), 1)
    land_files(spark, landing, many(10), 1)
    stream = windows.deduplicated(changes.event_stream(spark, landing), "1 day")
    changes.run(stream.select("event_id"), changes.into_table(store, "d"), store.path("_c"))
    assert store.read("d").count() == 10


# -- inventory and platforms ---------------------------------------------------------


def test_inventory_risk_and_alert_life_cycle(spark):
    day = dt.date(2001, 1, 1)
    rows = [
        order(1, 1, day, 10.0, product_id="a", stock_level_at_order=9, order_status="shipped") | {"seller_id": 0},
        order(2, 1, dt.date(2001, 1, 2), 30.0, product_id="a", stock_level_at_order=1,
              payment_status="pending") | {"seller_id": 0},
        order(3, 1, day, 10.0, product_id="b", stock_level_at_order=3) | {"seller_id": 0},
        order(4, 1, day, 10.0, product_id="c", stock_level_at_order=50) | {"seller_id": 0},
        order(5, 1, day, 10.0, product_id=None, stock_level_at_order=0) | {"seller_id": 0},
    ]
    sold, sellers = frame(spark, rows), frame(spark, [{"seller_id": 0, "seller_name": "S"}])
    risk = inventory.inventory_risk(sold, sellers)
    got = by(risk, "product_id")
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].current_stock_level, got["a"].pending_orders, got["a"].stock_after_pending) == (1, 2, -1)
    assert (got["a"].risk_level, got["a"].potential_revenue_loss) == ("STOCKOUT", 20.0)
    assert (got["b"].risk_level, got["c"].risk_level) == ("CRITICAL", "HEALTHY")
    first = inventory.stockout_alerts(risk, None, "2024-01-01 00:00:00")
    assert {r.alert_status for r in first.collect()} == {"OPEN"}
    second = by(inventory.stockout_alerts(risk.filter("product_id != 'b'"), first, NOW), "product_id")
    assert second["b"].alert_status == "CLOSED" and second["a"].alert_status == "OPEN"
    assert str(second["a"].alert_timestamp) == "2024-01-01 00:00:00"


def test_platform_switches_across_slices(spark, store):
    """One customer owns most orders, so their orders span several slices."""
    import random

    rng = random.Random(2)
    rows = []
    for i in range(600):
        who = 1 if i % 3 else rng.randrange(2, 30)
        rows.append({"order_id": i, "customer_id": who, "order_date": dt.date(2001, 1, 1) + dt.timedelta(days=i % 97),
                     "order_time": f"{i % 24:02d}:00:00", "order_source": rng.choice("abcd")})
    got = by(platforms.platform_switches(frame(spark, rows), store), "customer_id")
    groups = {}
    for r in sorted(rows, key=lambda r: (r["order_date"], r["order_time"], r["order_id"])):
        groups.setdefault(r["customer_id"], []).append(r["order_source"])
    assert set(got) == set(groups)
    for who, seq in groups.items():
        steps = len(seq) - 1
        rate = round(100 * sum(a != b for a, b in zip(seq, seq[1:])) / steps, 2) if steps else 0.0
        assert got[who].switch_rate_pct == rate


def test_cross_platform_identity(spark):
    day = dt.date(2001, 1, 1)
    rows = [order(1, 1, day, 10.0, order_source="web"), order(2, 1, day, 10.0, order_source="web"),
            order(3, 1, day, 90.0, order_source="app"), order(4, 2, day, 10.0, order_source="app")]
    profiles = platforms.customer_platform_profiles(frame(spark, rows))
    labels = frame(spark, [{"customer_id": 1, "extracted_value": "At Risk"}])
    _, customers = tables(spark)
    got = by(platforms.cross_platform_identity(profiles, customers, labels), "customer_id")
    assert (got[1].platform_count, got[1].all_platforms) == (2, "app,web")
    assert (got[1].highest_spend_platform, got[1].most_frequent_platform) == ("app", "web")
    assert (got[1].cross_platform_segment, got[2].cross_platform_segment) == ("DUAL_PLATFORM", "SINGLE_PLATFORM")
    assert (got[1].rfm_segment, got[2].rfm_segment) == ("At Risk", None)


def test_silence_of_exactly_the_gap_is_one_session(spark):
    for extra, want in ((0, 1), (1, 2)):
        rows = [event(1, 1, at=T0), event(2, 1, at=T0 + dt.timedelta(hours=6, seconds=extra))]
        assert windows.session_activity(events(spark, rows), "6 hours").count() == want


def test_waiting_events_are_seen_whatever_their_ids(spark):
    landed = events(spark, [event(i) for i in (1, 2, 9)])
    for merged, want in (([1, 9], True), ([1, 2, 9], False), ([], True)):
        ledger = spark.createDataFrame([(i,) for i in merged], schemas.EVENT_LEDGER)
        assert changes.has_new_data(landed, ledger).first().has_new_data is want
