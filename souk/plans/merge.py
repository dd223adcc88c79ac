"""Write-back: live order events become base orders, once each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.hashing import pick_from, salted_hash, salted_pick
from souk.functions.ladders import choose
from souk.functions.nulls import greatest_n, iff
from souk.operators.joins import not_in, split_join
from souk.operators.ranks import Asc, global_row_number, group_row_number
from souk.sources.buckets import Bucketed, touched
from souk.sources.schemas import EVENT_LEDGER, MAPPING, MERGED_IDS, ORDERS
from souk.sources.store import Store, conform

# Pick lists of the merged attributes, in hash order.
BRANDS = {0: "BrandA", 1: "BrandB", 2: "BrandC", 3: "BrandD"}
BRAND_OTHER = "BrandE"
PARTNERS = ["Delhivery", "BlueDart", "Ecom Express", "DTDC"]
RETURN_REASONS = ["Defective", "Wrong item", "Not as described", "Changed mind"]
CANCEL_REASONS = ["Customer request", "Out of stock", "Payment failed"]
ORDER_SOURCES = ["app", "web", "mobile"]
TRAFFIC_SOURCES = ["organic", "paid", "social", "direct"]
# Fraud threshold, refund share, delivery days that count as slow.
FRAUD_VALUE, REFUND_SHARE, SLOW_DAYS = 15000, 0.9, 5


def clock_time(moment: Column) -> Column:
    """HH:MM:SS of a timestamp without zone, whatever the session's zone."""
    return F.substring(moment.cast("string"), 12, 8)


def max_id(orders: DataFrame) -> Column:
    """Highest assigned id as a scalar subquery, 0 for an empty table."""
    return orders.agg(F.coalesce(F.max("order_id"), F.lit(0))).scalar()


def highest_id(orders: DataFrame) -> int:
    """The same as a number, for a table that does not change meanwhile."""
    return orders.agg(F.coalesce(F.max("order_id"), F.lit(0)).alias("id")).first().id


def unmerged(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events not yet merged; a redelivered event id counts once."""
    return not_in(events.dropDuplicates(["event_id"]), ledger, "event_id")


def rejects(fresh: DataFrame, merged: DataFrame) -> DataFrame:
    """Events no order was made for (unknown customers); they count as merged."""
    return not_in(fresh, merged, "event_id")


def numbered_events(
    fresh: DataFrame, customers: DataFrame, store: Store, name: str
) -> DataFrame:
    """Events of known customers with shipping place and their global rank."""
    places = customers.select(
        "customer_id",
        F.col("city").alias("shipping_city"),
        F.col("state").alias("shipping_state"),
        F.col("pincode").alias("shipping_pincode"),
    )
    known = split_join(fresh, places, "customer_id", spread="event_id")
    order = [Asc("event_timestamp"), Asc("event_id")]
    return global_row_number(known, order, store, name, out="rank")


def merged_orders(numbered: DataFrame, last_id: Column) -> DataFrame:
    """Full order rows (plus event and seller id) for numbered events."""
    c, event = F.col, F.col("event_id")
    value = c("order_value")
    qty = greatest_n(F.lit(1).cast("long"), salted_pick(event, "qty", 5))
    product = (salted_hash(event) % 500 + 1).cast("string")
    share = lambda salt, low, n: F.round(value * (low + salted_pick(event, salt, n)) / 100, 2)
    every_third = lambda salt, text: F.when(salted_pick(event, salt, 3) == 0, text)
    tagged = lambda prefix, n: F.concat(F.lit(prefix), (salted_hash(event) % n).cast("string"))
    cod = c("payment_type") == "COD"
    rows = numbered.withColumns(
        {
            "order_id": last_id + c("rank"),
            "order_date": F.to_date("event_timestamp"),
            "order_time": clock_time(c("event_timestamp")),
            "product_id": F.concat(F.lit("P"), product),
            "product_name": F.concat(F.lit("Product_"), product),
            "brand": choose(salted_pick(event, "brand", 5), BRANDS, BRAND_OTHER),
            "sub_category": F.concat("category", F.lit("_sub")),
            "quantity": qty,
            "unit_price": F.round(value / qty, 2),
            "discount_amount": share("disc", 0, 20),
            "coupon_code": every_third("coupon", tagged("COUP", 100)),
            "payment_status": iff(c("is_cancelled"), "Refunded", "Completed"),
            "order_status": F.when(c("is_cancelled"), "Cancelled")
            .when(c("is_returned"), "Returned")
            .otherwise("Delivered"),
            "delivery_partner": pick_from(event, "dp", PARTNERS),
            "warehouse_id": F.concat(
                F.lit("WH"), (salted_pick(event, "wh", 10) + 1).cast("string")
            ),
            "return_reason": F.when(c("is_returned"), pick_from(event, "rr", RETURN_REASONS)),
            "refund_amount": iff(c("is_returned"), F.round(value * REFUND_SHARE, 2), 0.0),
            "cancellation_reason": F.when(
                c("is_cancelled"), pick_from(event, "cr", CANCEL_REASONS)
            ),
            "cod_flag": iff(cod, True, False),
            "inventory_available_flag": F.lit(True),
            "stock_level_at_order": salted_pick(event, "stk", 500) + 10,
            "high_rto_risk_flag": iff(
                c("is_returned") & (c("delivery_time_days") > SLOW_DAYS), True, False
            ),
            "fraud_flag": iff((value > FRAUD_VALUE) & cod, True, False),
            "order_source": pick_from(event, "src", ORDER_SOURCES),
            "traffic_source": pick_from(event, "trf", TRAFFIC_SOURCES),
            "campaign_id": every_third("cmp", tagged("CMP", 50)),
            "margin": share("mgn", 15, 20),
            "profit": share("pft", 5, 15),
        }
    )
    orders = [c(f.name).cast(f.dataType).alias(f.name) for f in ORDERS.fields]
    return rows.select(*orders, "event_id", "seller_id")


def order_rows(merged: DataFrame) -> DataFrame:
    return conform(merged, ORDERS)


def mapping_rows(merged: DataFrame) -> DataFrame:
    """Mapping of merged orders, carried along by event id."""
    return conform(merged, MAPPING)


def mapping_by_value(orders: DataFrame, events: DataFrame, after_id) -> DataFrame:
    """Mapping found by (customer, day, value) instead of the event id.

    Two events of one customer with the same day and value match each other's
    orders as well; kept for comparison with ``mapping_rows``.
    """
    new = orders.filter(F.col("order_id") > after_id).select(
        "order_id", "customer_id", "product_id", "category", "order_date", "order_value"
    )
    seen = events.select(
        "customer_id",
        F.to_date("event_timestamp").alias("order_date"),
        "order_value",
        "seller_id",
    )
    return conform(new.join(seen, ["customer_id", "order_date", "order_value"]), MAPPING)


def mapping_one_to_one(
    orders: DataFrame, events: DataFrame, after_id, store: Store, slices: int | None = None
) -> DataFrame:
    """As ``mapping_by_value``, but each order and each event is used once.

    Of equal (customer, day, value) the n-th order by id goes with the n-th
    event by time, then id.  What has no partner left is in no row; nor is
    what has no customer, day or value.  A customer may own any share of the
    rows: numbers within a group come from the global order, and the join is
    by (customer, day, value, number).
    """
    by = ["customer_id", "order_date", "order_value"]
    new = orders.filter(F.col("order_id") > after_id).select("order_id", "product_id", "category", *by)
    seen = events.select(
        "customer_id",
        F.to_date("event_timestamp").alias("order_date"),
        "order_value",
        "seller_id",
        "event_timestamp",
        "event_id",
    )
    of_orders = group_row_number(new, by, [Asc("order_id")], store, "matched_orders", "_nth", slices)
    when = [Asc("event_timestamp"), Asc("event_id")]
    of_events = group_row_number(seen, by, when, store, "matched_events", "_nth", slices)
    return conform(of_orders.join(of_events, [*by, "_nth"]), MAPPING)


def merge_epoch(
    store: Store, events: DataFrame, last_base_id: int, customers: DataFrame, epoch: int
) -> None:
    """Merge one batch of events into the stored tables under ``epoch``.

    Orders and mapping are written first and the ledger last, each in the
    batch's own folder.  A batch that fails halfway is simply run again: it
    ignores its own earlier output and rewrites it.  Events that any other
    batch has merged are left out.  ``last_base_id`` is the highest id of the
    base orders; the highest merged one is kept per batch, so no orders are read.
    """
    ledger = ledger_of(store)
    seen = ledger.read_batches(touched(events, "event_id", ledger.buckets), without=epoch)
    # Semi join first: the ledger is cut down to the batch's ids (by a runtime Bloom
    # filter of them, where the ledger is large) before anything of it is shuffled.
    seen = seen.join(events.select("event_id"), "event_id", "left_semi")
    fresh = store.replace(f"_fresh/{epoch}", unmerged(events, seen))
    earlier = store.read_except("merged_ids", epoch, MERGED_IDS).agg(F.max("last_id")).first()[0]
    last = F.lit(max(last_base_id, earlier or 0))
    numbered = numbered_events(fresh, customers, store, f"merge-{epoch}")
    full = store.replace(f"_merged/{epoch}", merged_orders(numbered, last))
    store.append("orders_merged", order_rows(full), epoch)
    store.append("mapping_merged", mapping_rows(full), epoch)
    store.append("events_rejected", rejects(fresh, full), epoch)
    store.append("merged_ids", full.agg(F.max("order_id").alias("last_id")), epoch)
    ledger.append(fresh.select("event_id"), epoch)


def ledger_of(store: Store) -> Bucketed:
    """Ids of merged events, in buckets: a batch reads those that its own ids fall into."""
    return Bucketed(store, "realtime_events_merged", "event_id", EVENT_LEDGER)
