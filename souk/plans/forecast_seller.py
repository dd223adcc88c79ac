"""Seller outlook: tier, revenue, risk, operations, profit and investment forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.ladders import ladder
from souk.functions.nulls import clamp, greatest_n, iff, least_n, or_zero, sign_like

KEY = "seller_id"

# First matching row wins; "@name" refers to a column.
# Names used: score, risk, gscore (seller scores), g (growth %), rr (return %),
# fraud (fraud %), late (late %), days (delivery days), margin (profit %),
# disc (discount %), repeat (repeat customers %), roi, flagged (high-risk flag).
PREDICTED_TIER = [
    ("silver", [("seller_tier", "=", "bronze"), ("score", ">=", 60), ("gscore", ">=", 50)]),
    ("gold", [("seller_tier", "=", "silver"), ("score", ">=", 75), ("gscore", ">=", 65)]),
    ("platinum", [("seller_tier", "=", "gold"), ("score", ">=", 90), ("gscore", ">=", 80)]),
    ("gold", [("seller_tier", "=", "platinum"), ("risk", ">=", 60)]),
    ("gold", [("seller_tier", "=", "platinum"), ("g", "<", -10)]),
    ("silver", [("seller_tier", "=", "gold"), ("risk", ">=", 70)]),
    ("silver", [("seller_tier", "=", "gold"), ("g", "<", -15)]),
    ("bronze", [("seller_tier", "=", "silver"), ("risk", ">=", 80)]),
    ("bronze", [("seller_tier", "=", "silver"), ("g", "<", -20)]),
]
GROWTH_TREND = [
    ("ACCELERATING", [("g", ">=", 30)]),
    ("GROWING", [("g", ">=", 10)]),
    ("STABLE", [("g", ">=", 0)]),
    ("SLOWING", [("g", ">=", -10)]),
]
RISK_FORECAST = [
    ("CRITICAL", [("risk", ">=", 70), ("rr", ">", 20)]),
    ("HIGH", [("risk", ">=", 60)]),
    ("HIGH", [("rr", ">", 15)]),
    ("HIGH", [("fraud", ">", 5)]),
    ("ELEVATED", [("risk", ">=", 40)]),
    ("ELEVATED", [("rr", ">", 10)]),
]
CUSTOMER_BASE = [
    ("STRONG GROWTH", [("g", ">", 20), ("repeat", ">", 40)]),
    ("MODERATE GROWTH", [("g", ">", 10), ("repeat", ">", 30)]),
    ("STABLE", [("g", ">", 0)]),
    ("RETAINED BUT SHRINKING", [("repeat", ">", 50)]),
]
OPS_FORECAST = [
    ("DETERIORATING", [("late", ">", 30)]),
    ("DETERIORATING", [("days", ">", 8)]),
    ("AT RISK", [("late", ">", 15)]),
    ("AT RISK", [("days", ">", 6)]),
    ("ACCEPTABLE", [("late", ">", 5)]),
]
PROFIT_TRAJECTORY = [
    ("STRONG & SUSTAINABLE", [("margin", ">", 15), ("disc", "<", 10)]),
    ("HEALTHY", [("margin", ">", 10)]),
    ("DISCOUNT DEPENDENT", [("margin", ">", 5), ("disc", ">", 20)]),
    ("THIN MARGINS", [("margin", ">", 0)]),
]
PREDICTED_PERFORMANCE = [
    ("Good Performer", [("performance", "=", "Top Performer"), ("g", "<", -10)]),
    ("Top Performer", [("performance", "=", "Good Performer"), ("score", ">=", 80), ("g", ">", 15)]),
    ("Average Performer", [("performance", "=", "Good Performer"), ("g", "<", -15)]),
    (
        "Good Performer",
        [("performance", "=", "Average Performer"), ("score", ">=", 65), ("g", ">", 20)],
    ),
    ("Needs Improvement", [("performance", "=", "Average Performer"), ("risk", ">=", 70)]),
]
INVESTMENT = [
    ("DIVEST", [("flagged", "is", True), ("g", "<", 0)]),
    ("RESTRICT", [("risk", ">=", 70)]),
    ("INVEST HEAVILY", [("score", ">=", 80), ("g", ">=", 20)]),
    ("INVEST MODERATELY", [("score", ">=", 60), ("g", ">=", 10)]),
    ("MAINTAIN", [("score", ">=", 60), ("g", ">=", 0)]),
    ("REDUCE EXPOSURE", [("g", "<", -10)]),
]
RECOMMENDED_ACTION = [
    ("IMMEDIATE_QUALITY_AUDIT", [("flagged", "is", True), ("rr", ">", 20)]),
    ("RISK_MITIGATION_PLAN", [("risk", ">=", 70)]),
    ("LOGISTICS_OVERHAUL", [("late", ">", 30)]),
    ("GROWTH_RECOVERY_PROGRAM", [("g", "<", -15)]),
    ("MARKETING_OPTIMIZATION", [("roi", "<", 0)]),
    ("SCALE_UP_SUPPORT", [("score", ">=", 80), ("g", ">=", 20)]),
    ("PRICING_STRATEGY_REVIEW", [("margin", "<", 5), ("disc", ">", 20)]),
]

# Short names used in the rules and formulas -> columns of the seller mart.
SHORT = {
    "score": "seller_score",
    "risk": "seller_risk_score",
    "gscore": "seller_growth_score",
    "g": "growth_rate_pct",
    "rr": "actual_return_rate_pct",
    "cr": "actual_cancel_rate_pct",
    "fraud": "fraud_rate_pct",
    "late": "late_delivery_pct",
    "days": "avg_delivery_days_actual",
    "margin": "profit_margin_pct",
    "disc": "avg_discount_pct",
    "repeat": "repeat_customer_pct",
    "roi": "marketing_roi",
    "flagged": "is_high_risk_seller",
    "performance": "performance_segment",
    "value": "total_order_value",
    "monthly": "profile_monthly_sales",
}

# Risk escalation: (measure, value that counts as full, weight).
RISK_PARTS = [("rr", 50.0, 0.25), ("cr", 30.0, 0.20), ("fraud", 10.0, 0.25), ("risk", 100.0, 0.20)]
SHRINK_FULL, SHRINK_WEIGHT = 20.0, 0.10


def risk_escalation() -> Column:
    g = F.col("g")
    total = None
    for name, full, weight in RISK_PARTS:
        part = or_zero(F.col(name)) / F.lit(full) * weight
        total = part if total is None else total + part
    shrink = iff(g < 0, F.abs(g) / F.lit(SHRINK_FULL), 0.0) * SHRINK_WEIGHT
    return least_n(F.lit(1.0), total + shrink)


def operational_health() -> Column:
    """100 minus penalties, kept within 0..100; null without order measures."""
    slow = greatest_n(F.lit(0.0), F.col("days") - 3) * 8
    penalty = F.lit(100.0) - slow - F.col("late") * 1.5 - F.col("rr") - F.col("cr") * 1.2
    return clamp(penalty, 0.0, 100.0)


def sustainability() -> Column:
    c = F.col
    return (
        c("score") / 100 * 0.25
        + c("gscore") / 100 * 0.20
        + (100 - c("risk")) / 100 * 0.20
        + or_zero(c("repeat")) / 100 * 0.15
        + least_n(F.lit(100.0), or_zero(c("margin"))) / 100 * 0.10
        + sign_like(c("roi")) * 0.10
    )


def projected_revenue() -> Column:
    """Next 90 days from monthly sales, else a quarter of the measured value."""
    c = F.col
    growth = 1 + c("g") / 100
    return iff(c("monthly") > 0, c("monthly") * 3 * growth, c("value") * 0.25 * growth)


def forecast_seller_outlook(sellers_360: DataFrame, now: str) -> DataFrame:
    """One forecast row per seller."""
    c = F.col
    base = sellers_360.withColumns({short: c(name) for short, name in SHORT.items()})
    base = base.withColumn("escalation", risk_escalation())
    return base.select(
        KEY,
        "seller_name",
        "seller_type",
        "seller_category",
        "seller_city",
        "years_on_platform",
        c("seller_tier").alias("current_seller_tier"),
        ladder(PREDICTED_TIER, "@seller_tier").alias("predicted_seller_tier"),
        F.round("value", 2).alias("current_revenue"),
        F.round(projected_revenue(), 2).alias("projected_revenue_90d"),
        F.round("g", 2).alias("current_growth_rate"),
        ladder(GROWTH_TREND, "DECLINING").alias("revenue_growth_trend"),
        c("risk_segment").alias("current_risk_segment"),
        F.round("escalation", 3).alias("risk_escalation_probability"),
        ladder(RISK_FORECAST, "STABLE").alias("risk_forecast"),
        c("unique_customers").alias("current_unique_customers"),
        F.round("repeat", 2).alias("repeat_customer_pct"),
        ladder(CUSTOMER_BASE, "DECLINING").alias("customer_base_trend"),
        F.round("days", 1).alias("current_avg_delivery_days"),
        F.round("late", 2).alias("current_late_delivery_pct"),
        F.round(operational_health(), 2).alias("operational_health_score"),
        ladder(OPS_FORECAST, "HEALTHY").alias("operational_health_forecast"),
        F.round("margin", 2).alias("current_profit_margin_pct"),
        ladder(PROFIT_TRAJECTORY, "LOSS MAKING").alias("profit_trajectory"),
        c("performance").alias("current_performance"),
        ladder(PREDICTED_PERFORMANCE, "@performance").alias("predicted_performance"),
        F.round(sustainability(), 3).alias("sustainability_score"),
        F.round(c("value") * c("escalation"), 2).alias("revenue_at_risk"),
        ladder(INVESTMENT, "MONITOR").alias("investment_recommendation"),
        ladder(RECOMMENDED_ACTION, "STANDARD_MONITORING").alias("recommended_action"),
        F.lit(now).cast("timestamp_ntz").alias("forecast_generated_at"),
    )
