"""Customer outlook: tier, segment, churn, value, order and upsell forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.ladders import ladder
from souk.functions.nulls import iff, least_n, or_zero

KEY = "customer_id"

# First matching row wins; "@name" refers to a column.
# Names used: clv, eng, churn, disc, d (days since last order), mor (orders
# per 30 days), exposed (clv * churn), upsell.
PREDICTED_TIER = [
    ("silver", [("loyalty_tier", "=", "bronze"), ("clv", ">", 100000), ("eng", ">", 0.6)]),
    ("gold", [("loyalty_tier", "=", "silver"), ("clv", ">", 200000), ("eng", ">", 0.7)]),
    ("platinum", [("loyalty_tier", "=", "gold"), ("clv", ">", 350000), ("eng", ">", 0.8)]),
    ("gold", [("loyalty_tier", "=", "platinum"), ("churn", ">", 0.7), ("eng", "<", 0.3)]),
    ("silver", [("loyalty_tier", "=", "gold"), ("churn", ">", 0.7), ("eng", "<", 0.3)]),
]
PREDICTED_SEGMENT = [
    ("At Risk", [("segment", "=", "Champion"), ("d", ">", 60)]),
    ("Potential Loyalist", [("segment", "=", "Champion"), ("d", ">", 30)]),
    ("Champion", [("segment", "=", "Potential Loyalist"), ("mor", ">=", 3), ("m_score", ">=", 4)]),
    ("At Risk", [("segment", "=", "Potential Loyalist"), ("d", ">", 90)]),
    (
        "Potential Loyalist",
        [("segment", "=", "New Customer"), ("f_score", ">=", 3), ("m_score", ">=", 3)],
    ),
    ("At Risk", [("segment", "=", "New Customer"), ("d", ">", 60)]),
    ("At Risk", [("segment", "=", "At Risk"), ("d", ">", 120)]),
]
CHURN_30D = [
    ("VERY HIGH", [("churn", ">", 0.7), ("d", ">", 60), ("eng", "<", 0.3)]),
    ("HIGH", [("churn", ">", 0.7)]),
    ("HIGH", [("d", ">", 45), ("eng", "<", 0.4)]),
    ("MEDIUM", [("churn", ">", 0.4)]),
    ("MEDIUM", [("d", ">", 30)]),
]
RETENTION_PRIORITY = [
    ("CRITICAL", [("exposed", ">", 100000)]),
    ("HIGH", [("churn", ">", 0.7), ("clv", ">", 50000)]),
    ("MEDIUM", [("churn", ">", 0.5)]),
]
PERSONA_STABILITY = [
    ("STABLE", [("eng", ">", 0.7), ("disc", "<", 0.3)]),
    ("LIKELY STABLE", [("eng", ">", 0.5), ("disc", "<", 0.5)]),
    ("LIKELY SHIFTING", [("churn", ">", 0.6)]),
    ("LIKELY SHIFTING", [("eng", "<", 0.3)]),
]
INTERVENTION = [
    ("IMMEDIATE_WINBACK_CAMPAIGN", [("exposed", ">", 100000)]),
    ("PERSONALIZED_RETENTION_OFFER", [("churn", ">", 0.7), ("d", ">", 60), ("eng", "<", 0.3)]),
    ("LOYALTY_BONUS_ACTIVATION", [("churn", ">", 0.7)]),
    ("UPSELL_CROSS_SELL_CAMPAIGN", [("upsell", ">", 0.6)]),
    ("ENGAGEMENT_REACTIVATION", [("churn", ">", 0.6)]),
    ("ENGAGEMENT_REACTIVATION", [("eng", "<", 0.3)]),
]
# Second variant, decided on the forecast columns themselves.
INTERVENTION_V2 = [
    ("IMMEDIATE_WINBACK_CAMPAIGN", [("retention_priority", "=", "CRITICAL")]),
    ("PERSONALIZED_RETENTION_OFFER", [("churn_prediction_30d", "=", "VERY HIGH")]),
    ("LOYALTY_BONUS_ACTIVATION", [("churn_prediction_30d", "=", "HIGH")]),
    ("UPSELL_CROSS_SELL_CAMPAIGN", [("upsell_potential_score", ">", 0.6)]),
    ("ENGAGEMENT_REACTIVATION", [("persona_stability", "=", "LIKELY SHIFTING")]),
    ("SEGMENT_TRANSITION_NURTURE", [("predicted_rfm_segment", "!=", "@current_rfm_segment")]),
]
INTERVENTION_OTHER = "STANDARD_ENGAGEMENT"

# Share of the usual order rate expected after a quiet spell: (days, share).
QUIET_DISCOUNT = [(90, 0.3), (60, 0.5), (30, 0.8)]

# Churn probability weights: profile churn, quiet days, lost engagement, low rate.
W_CHURN, W_QUIET, W_ENGAGE, W_RATE = 0.4, 0.3, 0.2, 0.1
QUIET_DAYS, FULL_RATE = 120.0, 5.0


def churn_probability(churn: Column, d: Column, eng: Column, mor: Column) -> Column:
    """Weighted churn probability, capped at 1; null when any input is null."""
    quiet = least_n(F.lit(1.0), d / F.lit(QUIET_DAYS))
    rate = least_n(F.lit(1.0), mor / F.lit(FULL_RATE))
    parts = churn * W_CHURN + quiet * W_QUIET + (1 - eng) * W_ENGAGE + (1 - rate) * W_RATE
    return least_n(F.lit(1.0), parts)


def upsell_potential(aov: Column, max_order: Column, categories: Column, brands: Column) -> Column:
    headroom = iff((max_order > 0) & (aov > 0), (1 - aov / F.nullif(max_order, F.lit(0.0))) * 0.4, 0.0)
    breadth = lambda c: least_n(F.lit(1.0), c / F.lit(10.0)) * 0.3
    return headroom + breadth(categories) + breadth(brands)


def responsiveness() -> Column:
    share = lambda name: or_zero(F.col(name)) / F.lit(100.0) * 0.2
    return (
        or_zero(F.col("avg_engagement_score")) * 0.3
        + share("open_rate_pct")
        + share("click_rate_pct")
        + share("conversion_rate_pct")
        + (1 - or_zero(F.col("avg_fatigue_score"))) * 0.1
    )


def _expected_orders(d: Column, mor: Column) -> Column:
    out = None
    for days, share in QUIET_DISCOUNT:
        out = (F if out is None else out).when(d > days, mor * share)
    return out.otherwise(mor)


def forecast_customer_outlook(
    customers_360: DataFrame, segments: DataFrame, as_of: str, now: str
) -> DataFrame:
    """One forecast row per customer.

    The intermediate measures are computed once in a first projection and the
    forecast reads them; both projections collapse into one codegen stage.
    """
    scores = segments.select(KEY, "f_score", "m_score", F.col("extracted_value").alias("segment"))
    span = F.col("order_span_days")
    base = customers_360.join(scores, KEY, "left").withColumns(
        {
            "clv": F.col("profile_clv"),
            "eng": F.col("profile_engagement_score"),
            "churn": F.col("churn_risk_score"),
            "disc": F.col("discount_sensitivity_score"),
            "aov": F.col("avg_order_value"),
            "d": F.date_diff(F.lit(as_of).cast("date"), "last_order_date"),
            "mor": iff(
                span > 0, F.col("total_orders") * F.lit(30.0) / F.nullif(span, F.lit(0)), 0.0
            ),
        }
    )
    c = F.col
    probability = churn_probability(c("churn"), c("d"), c("eng"), c("mor"))
    upsell = upsell_potential(
        c("aov"),
        c("max_order_value"),
        c("unique_categories_purchased"),
        c("unique_brands_purchased"),
    )
    base = base.withColumns(
        {"probability": probability, "upsell": upsell, "exposed": c("clv") * c("churn")}
    )
    quarter = c("mor") * c("aov") * 3
    return base.select(
        KEY,
        F.concat("first_name", F.lit(" "), "last_name").alias("customer_name"),
        "city",
        "state",
        "persona",
        c("loyalty_tier").alias("current_loyalty_tier"),
        ladder(PREDICTED_TIER, "@loyalty_tier").alias("predicted_loyalty_tier"),
        c("segment").alias("current_rfm_segment"),
        ladder(PREDICTED_SEGMENT, "@segment").alias("predicted_rfm_segment"),
        F.round("churn", 3).alias("current_churn_risk"),
        ladder(CHURN_30D, "LOW").alias("churn_prediction_30d"),
        F.round("probability", 3).alias("churn_probability_score"),
        F.round("clv", 2).alias("current_clv"),
        F.round(c("clv") + quarter, 2).alias("projected_clv_90d"),
        F.round(
            iff(c("clv") > 0, quarter / F.nullif(c("clv"), F.lit(0.0)) * 100, 0.0), 2
        ).alias("clv_growth_pct_90d"),
        F.round("mor", 2).alias("current_monthly_order_rate"),
        F.round(_expected_orders(c("d"), c("mor")), 2).alias("predicted_orders_next_30d"),
        F.round("upsell", 3).alias("upsell_potential_score"),
        F.round(c("clv") * c("probability"), 2).alias("revenue_at_risk"),
        ladder(RETENTION_PRIORITY, "LOW").alias("retention_priority"),
        ladder(PERSONA_STABILITY, "MONITOR").alias("persona_stability"),
        F.round(responsiveness(), 3).alias("marketing_responsiveness_score"),
        ladder(INTERVENTION, INTERVENTION_OTHER).alias("recommended_intervention"),
        F.lit(now).cast("timestamp_ntz").alias("forecast_generated_at"),
    )


def forecast_customer_outlook_v2(
    customers_360: DataFrame, segments: DataFrame, as_of: str, now: str
) -> DataFrame:
    """Same forecast with the intervention decided on the forecast columns."""
    forecast = forecast_customer_outlook(customers_360, segments, as_of, now)
    return forecast.withColumn(
        "recommended_intervention", ladder(INTERVENTION_V2, INTERVENTION_OTHER)
    )
