"""Customer 360: order facts and marketing facts joined to the customer profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.exact import exact_avg, exact_sum
from souk.functions.nulls import or_zero, pct
from souk.operators.profile import Profile, distinct_counts, value_profile

KEY = "customer_id"


def customer_order_facts(orders: DataFrame) -> DataFrame:
    """Order measures, one row per customer."""
    n = F.count("*")
    payment = F.lower("payment_type")
    measures = orders.groupBy(KEY).agg(
        n.alias("total_orders"),
        exact_sum(F.col("order_value")).alias("total_order_value"),
        exact_sum(F.col("discount_amount")).alias("total_discount_amount"),
        exact_avg(F.col("order_value")).alias("avg_order_value"),
        F.max("order_value").alias("max_order_value"),
        F.min("order_value").alias("min_order_value"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.date_diff(F.max("order_date"), F.min("order_date")).alias("order_span_days"),
        F.sum("quantity").alias("total_items_purchased"),
        F.avg("quantity").alias("avg_items_per_order"),
        F.count_if("is_returned").alias("total_returns"),
        F.count_if("is_cancelled").alias("total_cancellations"),
        exact_sum(F.col("refund_amount")).alias("total_refund_amount"),
        pct(F.count_if("is_returned"), n).alias("return_rate_pct"),
        pct(F.count_if("is_cancelled"), n).alias("cancellation_rate_pct"),
        *[F.count_if(payment == p).alias(f"{p}_orders") for p in ("cod", "upi", "card", "wallet")],
        pct(F.count_if("cod_flag"), n).alias("cod_pct"),
        F.count_if(F.lower("order_status") == "delivered").alias("delivered_orders"),
        F.avg("delivery_time_days").alias("avg_delivery_days"),
        F.avg("customer_rating").alias("avg_customer_rating"),
        F.count_if("high_rto_risk_flag").alias("high_rto_risk_orders"),
        F.count_if("fraud_flag").alias("fraud_flagged_orders"),
        exact_sum(F.col("margin")).alias("total_margin"),
        exact_sum(F.col("profit")).alias("total_profit"),
    )
    profile = value_profile(
        orders,
        KEY,
        Profile(
            modes={
                "most_frequent_category": "category",
                "most_frequent_brand": "brand",
                "preferred_payment_type": "payment_type",
                "preferred_order_source": "order_source",
            },
            distincts={
                "unique_categories_purchased": "category",
                "unique_brands_purchased": "brand",
            },
        ),
    )
    unique = distinct_counts(orders, KEY, {"unique_orders": "order_id"})
    joined = measures.join(profile, KEY, "left").join(unique, KEY, "left")
    # A customer whose categories or brands are all unknown has no profile row.
    counts = ["unique_categories_purchased", "unique_brands_purchased"]
    return joined.fillna(0, counts).select(ORDER_FACTS_KEYED)


def customer_marketing_facts(interactions: DataFrame) -> DataFrame:
    """Marketing measures, one row per customer."""
    delivered = F.count_if(F.col("delivery_status") == "delivered")
    opened, clicked = F.count_if("open_flag"), F.count_if("click_flag")
    converted = F.count_if("conversion_flag")
    cost = exact_sum(F.col("marketing_cost"))
    revenue = exact_sum(F.col("revenue_generated"))
    channels = {"email": "email", "whatsapp": "whatsapp", "sms": "sms", "push": "push_notification"}
    measures = interactions.groupBy(KEY).agg(
        F.count("*").alias("total_marketing_interactions"),
        *[
            F.count_if(F.col("channel") == value).alias(f"{short}_interactions")
            for short, value in channels.items()
        ],
        delivered.alias("messages_delivered"),
        opened.alias("messages_opened"),
        clicked.alias("messages_clicked"),
        converted.alias("messages_converted"),
        pct(opened, delivered).alias("open_rate_pct"),
        pct(clicked, opened).alias("click_rate_pct"),
        pct(converted, clicked).alias("conversion_rate_pct"),
        exact_sum(F.col("conversion_value")).alias("total_marketing_conversion_value"),
        F.avg("time_to_open_seconds").alias("avg_time_to_open_seconds"),
        F.avg("time_to_click_seconds").alias("avg_time_to_click_seconds"),
        exact_avg(F.col("engagement_score")).alias("avg_engagement_score"),
        exact_avg(F.col("propensity_to_buy_score")).alias("avg_propensity_score"),
        F.count_if("unsubscribe_flag").alias("unsubscribe_count"),
        F.count_if("spam_flag").alias("spam_flag_count"),
        exact_avg(F.col("fatigue_score")).alias("avg_fatigue_score"),
        F.avg("frequency_last_7_days").alias("avg_freq_last_7_days"),
        F.avg("frequency_last_30_days").alias("avg_freq_last_30_days"),
        cost.alias("total_marketing_cost"),
        revenue.alias("total_marketing_revenue"),
        F.round(revenue / F.nullif(cost, F.lit(0.0)), 2).alias("marketing_roi"),
    )
    # Hours are padded so that "smallest on ties" is numeric.
    padded = interactions.withColumn(
        "best_send_time_hour", F.lpad(F.col("best_send_time_hour").cast("string"), 2, "0")
    )
    profile = value_profile(
        padded,
        KEY,
        Profile(
            modes={
                "best_send_time_hour": "best_send_time_hour",
                "preferred_channel": "channel",
                "preferred_device_marketing": "device_type",
            },
            distincts={"unique_campaigns_received": "campaign_id"},
            # Alphabetical maximum, kept under its historical name.
            largest={
                "latest_customer_segment": "customer_segment",
                "latest_risk_segment": "customer_risk_segment",
            },
        ),
    ).withColumn("best_send_time_hour", F.col("best_send_time_hour").cast("int"))
    joined = measures.join(profile, KEY, "left").fillna(0, ["unique_campaigns_received"])
    return joined.select(MARKETING_FACTS_KEYED)


# Column orders of the marts.  Fixed values: "*" marks counts and sums, which
# read 0 for a customer without rows; the other measures stay null.
ORDER_FACTS = """total_orders* unique_orders* total_order_value* total_discount_amount*
    avg_order_value max_order_value min_order_value first_order_date last_order_date
    order_span_days total_items_purchased* avg_items_per_order
    unique_categories_purchased* unique_brands_purchased* total_returns*
    total_cancellations* total_refund_amount* return_rate_pct cancellation_rate_pct
    cod_orders* upi_orders* card_orders* wallet_orders* cod_pct delivered_orders*
    avg_delivery_days avg_customer_rating high_rto_risk_orders* fraud_flagged_orders*
    total_margin* total_profit* most_frequent_category most_frequent_brand
    preferred_payment_type preferred_order_source""".split()

MARKETING_FACTS = """total_marketing_interactions* unique_campaigns_received*
    email_interactions* whatsapp_interactions* sms_interactions* push_interactions*
    messages_delivered* messages_opened* messages_clicked* messages_converted*
    open_rate_pct click_rate_pct conversion_rate_pct total_marketing_conversion_value*
    avg_time_to_open_seconds avg_time_to_click_seconds avg_engagement_score
    avg_propensity_score unsubscribe_count* spam_flag_count* avg_fatigue_score
    avg_freq_last_7_days avg_freq_last_30_days best_send_time_hour total_marketing_cost*
    total_marketing_revenue* marketing_roi preferred_channel preferred_device_marketing
    latest_customer_segment latest_risk_segment""".split()

ORDER_FACTS_KEYED = [KEY, *[c.rstrip("*") for c in ORDER_FACTS]]
MARKETING_FACTS_KEYED = [KEY, *[c.rstrip("*") for c in MARKETING_FACTS]]

# Profile columns that get another name because a measured twin exists.
RENAMED = {
    "last_order_date": "profile_last_order_date",
    "last_order_value": "profile_last_order_value",
    "customer_lifetime_value": "profile_clv",
    "total_orders": "profile_total_orders",
    "engagement_score": "profile_engagement_score",
}


def gold_customer_360(
    customers: DataFrame, order_facts: DataFrame, marketing_facts: DataFrame, now: str
) -> DataFrame:
    """One row per customer: profile, order facts, marketing facts, derived columns."""
    profile = customers.select(
        *[F.col(c).alias(RENAMED.get(c, c)) for c in customers.columns]
    )
    joined = profile.join(order_facts, KEY, "left").join(marketing_facts, KEY, "left")
    facts = [
        or_zero(F.col(c[:-1])).alias(c[:-1]) if c.endswith("*") else F.col(c)
        for c in [*ORDER_FACTS, *MARKETING_FACTS]
    ]
    return joined.select(*profile.columns, *facts).withColumns(
        {
            "combined_revenue": F.col("total_order_value")
            + F.col("total_marketing_conversion_value"),
            "has_ordered": F.col("total_orders") > 0,
            "has_marketing_engagement": F.col("total_marketing_interactions") > 0,
            "created_at": F.lit(now).cast("timestamp_ntz"),
        }
    )
