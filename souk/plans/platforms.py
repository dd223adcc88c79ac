"""Cross-platform customer behaviour: profiles, identity and marketing insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exact import exact_sum
from souk.functions.ladders import ladder
from souk.functions.nulls import pct
from souk.operators.ranks import Asc, sorted_slices
from souk.sources.store import Store

KEY = "customer_id"

# Segment by number of platforms used.
SEGMENT = [
    ("OMNICHANNEL_POWER_USER", [("platform_count", ">=", 4)]),
    ("MULTI_PLATFORM", [("platform_count", "=", 3)]),
    ("DUAL_PLATFORM", [("platform_count", "=", 2)]),
]
# Cuts on total spend and switching (ours).
VALUE_LEVEL = [
    ("HIGH", [("total_spend_all_platforms", ">=", 250000)]),
    ("MEDIUM", [("total_spend_all_platforms", ">=", 100000)]),
]
MARKETING_SEGMENT = [
    ("VIP_OMNICHANNEL", [("platform_count", ">=", 3), ("total_revenue", ">=", 250000)]),
    ("PLATFORM_SWITCHER", [("switch_rate_pct", ">=", 75)]),
    ("GROWTH_POTENTIAL", [("platform_count", ">=", 2), ("total_revenue", ">=", 100000)]),
    ("SINGLE_CHANNEL_LOYAL", [("platform_count", "=", 1)]),
]
CAMPAIGN_ACTION = [
    ("EARLY_ACCESS_OFFER", [("marketing_action_segment", "=", "VIP_OMNICHANNEL")]),
    ("UNIFIED_CART_REMINDER", [("marketing_action_segment", "=", "PLATFORM_SWITCHER")]),
    ("CROSS_SELL_BUNDLE", [("marketing_action_segment", "=", "GROWTH_POTENTIAL")]),
    ("SECOND_CHANNEL_INCENTIVE", [("marketing_action_segment", "=", "SINGLE_CHANNEL_LOYAL")]),
]


def customer_platform_profiles(orders: DataFrame) -> DataFrame:
    """Orders and spend per customer, platform and channel."""
    keys = [KEY, "platform", "channel"]
    named = orders.withColumnsRenamed({"order_source": "platform", "traffic_source": "channel"})
    spend = exact_sum(F.col("order_value"))
    n = F.count("*")
    facts = named.groupBy(*keys).agg(
        n.alias("orders_on_platform"),
        spend.alias("total_spend_on_platform"),
        F.round(spend / n, 2).alias("avg_order_value_on_platform"),
        F.min("order_date").alias("first_order_on_platform"),
        F.max("order_date").alias("last_order_on_platform"),
        F.count_distinct("category").alias("categories_bought"),
    )
    return facts


def _per_platform(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy(KEY, "platform").agg(
        F.sum("orders_on_platform").alias("n"),
        exact_sum(F.col("total_spend_on_platform")).alias("spend"),
    )


def cross_platform_identity(
    profiles: DataFrame, customers: DataFrame, segments: DataFrame
) -> DataFrame:
    """One row per ordering customer with platform set and favourites.

    A customer has as many rows here as there are platforms, so the set and
    the favourites are small; ties go to the first platform by name.
    """
    c = F.col
    first_by = lambda measure: F.min(
        F.struct((-c(measure)).alias("m"), c("platform"))
    )["platform"]
    per_customer = (
        _per_platform(profiles)
        .groupBy(KEY)
        .agg(
            F.count("*").alias("platform_count"),
            F.concat_ws(",", F.array_sort(F.collect_set("platform"))).alias("all_platforms"),
            F.sum("n").alias("total_orders_all_platforms"),
            exact_sum(c("spend")).alias("total_spend_all_platforms"),
            first_by("spend").alias("highest_spend_platform"),
            first_by("n").alias("most_frequent_platform"),
        )
    )
    people = customers.select(
        KEY,
        F.concat("first_name", F.lit(" "), "last_name").alias("customer_name"),
        "loyalty_tier",
    )
    labels = segments.select(KEY, c("extracted_value").alias("rfm_segment"))
    return (
        per_customer.join(people, KEY)
        .join(labels, KEY, "left")
        .withColumn("cross_platform_segment", ladder(SEGMENT, "SINGLE_PLATFORM"))
        .withColumn("cross_platform_value", ladder(VALUE_LEVEL, "LOW"))
    )


def platform_switches(orders: DataFrame, store: Store) -> DataFrame:
    """Share of a customer's consecutive orders that change platform.

    Orders follow each other by (day, time, id).  The rows are sorted globally
    and cut into slices, so even a customer with a third of all orders is
    handled by many tasks: steps inside a slice are counted there, and the
    step from one slice to the next needs only the first and last platform of
    each (slice, customer) pair.
    """
    c = F.col
    steps = ["order_date", "order_time", "order_id"]
    placed = sorted_slices(
        orders.select(KEY, *steps, "order_source"), [Asc(KEY), *map(Asc, steps)], store, "switches"
    )
    inside = Window.partitionBy("_slice", KEY).orderBy("_pos")
    before = F.lag("order_source").over(inside)
    parts = (
        placed.select("_slice", KEY, "_pos", "order_source", before.alias("before"))
        .groupBy("_slice", KEY)
        .agg(
            F.count_if(c("order_source") != c("before")).alias("switched"),
            F.count("before").alias("steps"),
            F.min_by("order_source", "_pos").alias("first"),
            F.max_by("order_source", "_pos").alias("last"),
        )
    )
    # At most one row per slice and customer.
    last_slice = F.lag("last").over(Window.partitionBy(KEY).orderBy("_slice"))
    joined = parts.withColumn("before", last_slice).groupBy(KEY).agg(
        (F.sum("switched") + F.count_if(c("first") != c("before"))).alias("switched"),
        (F.sum("steps") + F.count("before")).alias("steps"),
    )
    rate = F.coalesce(pct(c("switched"), c("steps")), F.lit(0.0))
    return joined.select(KEY, rate.alias("switch_rate_pct"))


def cross_platform_marketing(identity: DataFrame, switches: DataFrame) -> DataFrame:
    return (
        identity.join(switches, KEY)
        .select(
            KEY,
            "platform_count",
            F.col("total_spend_all_platforms").alias("total_revenue"),
            "switch_rate_pct",
        )
        .withColumn("marketing_action_segment", ladder(MARKETING_SEGMENT, "OCCASIONAL"))
        .withColumn("recommended_campaign_action", ladder(CAMPAIGN_ACTION, "AWARENESS_NEWSLETTER"))
    )
