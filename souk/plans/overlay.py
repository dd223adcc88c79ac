"""Live overlay: recent activity per customer / seller and re-scored forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.exact import exact_avg, exact_sum
from souk.functions.ladders import ladder
from souk.functions.nulls import clamp, greatest_n, iff, or_zero, pct


def activity_measures() -> list[Column]:
    n = F.count("*")
    return [
        n.alias("recent_order_count"),
        F.round(exact_sum(F.col("order_value")), 2).alias("recent_order_value"),
        F.round(exact_avg(F.col("order_value")), 2).alias("recent_avg_order_value"),
        F.max("event_timestamp").alias("last_event_time"),
        F.count_if("is_returned").alias("recent_returns"),
        F.count_if("is_cancelled").alias("recent_cancellations"),
        F.round(F.avg("customer_rating"), 2).alias("recent_avg_rating"),
        F.round(F.avg("delivery_time_days"), 1).alias("recent_avg_delivery_days"),
        pct(F.count_if("is_returned"), n).alias("recent_return_rate"),
    ]


def customer_recent_activity(events: DataFrame) -> DataFrame:
    return events.groupBy("customer_id").agg(*activity_measures())


def seller_recent_activity(events: DataFrame) -> DataFrame:
    """As for customers, plus distinct customers."""
    measures = events.groupBy("seller_id").agg(*activity_measures())
    unique = events.groupBy("seller_id").agg(
        F.count_distinct("customer_id").alias("recent_unique_customers")
    )
    return measures.join(unique, "seller_id", "left")


# Fixed values of the overlay: score drop per recent order, and drops for a
# last order within 6 hours and within 1 hour.
PER_ORDER, WITHIN_6H, WITHIN_1H = 0.03, 0.10, 0.05

# Churn labels look at differently discounted scores: s0 counts orders only,
# s6 also the 6 hour bonus, s1 both bonuses.
REALTIME_CHURN = [
    ("VERY HIGH", [("s1", ">", 0.7)]),
    ("HIGH", [("s6", ">", 0.5)]),
    ("MEDIUM", [("s0", ">", 0.3)]),
]
# The change flag compares the baseline with its own variant of the ladder.
CHURN_FOR_CHANGE = [
    ("VERY HIGH", [("s6", ">", 0.7)]),
    ("HIGH", [("s6", ">", 0.5)]),
    ("MEDIUM", [("s0", ">", 0.3)]),
]
REALTIME_PRIORITY = [
    ("CRITICAL", [("live_exposed", ">", 100000)]),
    ("HIGH", [("s0", ">", 0.7), ("live_clv", ">", 50000)]),
    ("MEDIUM", [("s0", ">", 0.5)]),
]
REALTIME_RISK = [
    ("CRITICAL", [("x4", ">", 0.7)]),
    ("HIGH", [("x", ">", 0.5)]),
    ("ELEVATED", [("x", ">", 0.3)]),
]


def _within(hours: int, now: str) -> Column:
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    return F.col("last_event_time") >= since


def customer_overlay(forecast: DataFrame, activity: DataFrame, now: str) -> DataFrame:
    """Customer forecast re-scored with recent orders, one row per customer."""
    c = F.col
    live = forecast.join(activity, "customer_id", "left")
    by_orders = c("churn_probability_score") - or_zero(c("recent_order_count")) * PER_ORDER
    six = iff(_within(6, now), WITHIN_6H, 0.0)
    one = iff(_within(1, now), WITHIN_1H, 0.0)
    recent = or_zero(c("recent_order_value"))
    live = live.withColumns(
        {
            "s0": greatest_n(F.lit(0.0), by_orders),
            "s6": greatest_n(F.lit(0.0), by_orders - six),
            "s1": greatest_n(F.lit(0.0), by_orders - six - one),
            "live_clv": c("current_clv") + recent,
        }
    ).withColumn("live_exposed", c("live_clv") * c("s0"))
    for_change = ladder(CHURN_FOR_CHANGE, "LOW")
    return live.select(
        "customer_id",
        "customer_name",
        "city",
        "state",
        "persona",
        "current_loyalty_tier",
        "predicted_loyalty_tier",
        "current_rfm_segment",
        "predicted_rfm_segment",
        "current_churn_risk",
        c("churn_prediction_30d").alias("baseline_churn_prediction"),
        c("churn_probability_score").alias("baseline_churn_score"),
        or_zero(c("recent_order_count")).alias("realtime_order_count"),
        recent.alias("realtime_order_value"),
        c("last_event_time").alias("last_realtime_event"),
        F.round("s1", 3).alias("realtime_churn_score"),
        ladder(REALTIME_CHURN, "LOW").alias("realtime_churn_prediction"),
        F.round("live_clv", 2).alias("realtime_clv"),
        c("current_clv").alias("baseline_clv"),
        F.round(c("projected_clv_90d") + recent * 3, 2).alias("realtime_projected_clv_90d"),
        c("projected_clv_90d").alias("baseline_projected_clv_90d"),
        F.round(c("live_clv") * c("s6"), 2).alias("realtime_revenue_at_risk"),
        c("revenue_at_risk").alias("baseline_revenue_at_risk"),
        ladder(REALTIME_PRIORITY, "LOW").alias("realtime_retention_priority"),
        c("retention_priority").alias("baseline_retention_priority"),
        iff(c("churn_prediction_30d") != for_change, True, False).alias("prediction_changed"),
        "upsell_potential_score",
        "persona_stability",
        "marketing_responsiveness_score",
        "recommended_intervention",
        F.lit(now).cast("timestamp_ntz").alias("last_refreshed_at"),
    )


def seller_overlay(forecast: DataFrame, activity: DataFrame, now: str) -> DataFrame:
    """Seller forecast re-scored with recent orders, one row per seller."""
    c = F.col
    live = forecast.join(activity, "seller_id", "left")
    returns = or_zero(c("recent_return_rate"))
    well_rated = or_zero(c("recent_avg_rating")) >= 4
    busy = or_zero(c("recent_order_count")) >= 5
    fast = F.coalesce(c("recent_avg_delivery_days"), F.lit(99.0)) <= 3
    recent = or_zero(c("recent_order_value"))
    risk = c("risk_escalation_probability") + returns / 100 * 0.3
    rated = risk - iff(well_rated, 0.05, 0.0)
    live = live.withColumns(
        {
            "x": greatest_n(F.lit(0.0), risk),
            "x4": greatest_n(F.lit(0.0), rated),
            "live_revenue": c("current_revenue") + recent,
        }
    )
    lift = iff(
        c("current_revenue") > 0, recent / F.nullif(c("current_revenue"), F.lit(0.0)) * 100, 0.0
    )
    health = (
        c("operational_health_score") - returns * 0.5 + iff(fast, 5.0, 0.0) + iff(well_rated, 3.0, 0.0)
    )
    forecast_now = ladder(REALTIME_RISK, "STABLE")
    return live.select(
        "seller_id",
        "seller_name",
        "seller_type",
        "seller_category",
        "seller_city",
        "years_on_platform",
        "current_seller_tier",
        "predicted_seller_tier",
        c("current_revenue").alias("baseline_revenue"),
        F.round("live_revenue", 2).alias("realtime_revenue"),
        or_zero(c("recent_order_count")).alias("realtime_order_count"),
        recent.alias("realtime_order_value"),
        or_zero(c("recent_unique_customers")).alias("realtime_new_customers"),
        c("last_event_time").alias("last_realtime_event"),
        F.round(lift, 2).alias("realtime_revenue_lift_pct"),
        c("projected_revenue_90d").alias("baseline_projected_rev_90d"),
        F.round(c("projected_revenue_90d") + recent * 12, 2).alias("realtime_projected_rev_90d"),
        "revenue_growth_trend",
        "current_risk_segment",
        c("risk_forecast").alias("baseline_risk_forecast"),
        c("risk_escalation_probability").alias("baseline_risk_prob"),
        F.round(greatest_n(F.lit(0.0), rated - iff(busy, 0.03, 0.0)), 3).alias(
            "realtime_risk_score"
        ),
        forecast_now.alias("realtime_risk_forecast"),
        c("operational_health_score").alias("baseline_ops_health"),
        F.round(clamp(health, 0.0, 100.0), 2).alias("realtime_ops_health"),
        c("sustainability_score").alias("baseline_sustainability"),
        c("revenue_at_risk").alias("baseline_revenue_at_risk"),
        F.round(c("live_revenue") * c("x4"), 2).alias("realtime_revenue_at_risk"),
        "profit_trajectory",
        "customer_base_trend",
        "investment_recommendation",
        "recommended_action",
        iff(c("risk_forecast") != forecast_now, True, False).alias("prediction_changed"),
        F.lit(now).cast("timestamp_ntz").alias("last_refreshed_at"),
    )
