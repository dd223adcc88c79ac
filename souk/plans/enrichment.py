"""Rule-based labels and actions on top of the 360 marts."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.ladders import ladder
from souk.functions.nulls import clamp, or_zero
from souk.functions.text import sentiment
from souk.sources.store import Store

# Business actions per customer, first matching row wins.
CUSTOMER_ACTIONS = {
    "payment_action": (
        [
            ("BLOCK_COD", [("cod_pct", ">", 70), ("return_rate_pct", ">", 25)]),
            ("LIMIT_COD", [("cod_pct", ">", 60), ("return_rate_pct", ">", 20)]),
            ("ENABLE_PREPAID_DISCOUNT", [("cod_pct", ">", 40)]),
        ],
        "ALLOW_ALL_PAYMENTS",
    ),
    "delivery_action": (
        [
            ("USE_FASTEST_COURIER", [("avg_delivery_days", ">", 7), ("return_rate_pct", ">", 20)]),
            ("PRIORITIZE_EXPRESS_SHIPPING", [("avg_delivery_days", ">", 5)]),
        ],
        "STANDARD_DELIVERY",
    ),
    "inventory_action": (
        [
            ("PRIORITY_STOCK", [("total_orders", ">", 50)]),
            ("LOW_PRIORITY", [("total_orders", "=", 0)]),
        ],
        "NORMAL",
    ),
    "marketing_action": (
        [
            ("STOP_SPEND", [("marketing_roi", "<", 0)]),
            ("COOLDOWN", [("avg_fatigue_score", ">", 0.8)]),
            ("BOOST", [("avg_engagement_score", ">", 0.7)]),
        ],
        "OPTIMIZE",
    ),
    "cx_action": (
        [
            ("PROACTIVE_SUPPORT", [("total_cancellations", ">", 5)]),
            ("FEEDBACK_LOOP", [("avg_customer_rating", "<", 3)]),
        ],
        "STANDARD",
    ),
    "fraud_action": (
        [
            ("REVIEW", [("fraud_risk_score", ">", 0.4)]),
            ("BLOCK", [("fraud_flagged_orders", ">", 2)]),
        ],
        "MONITOR",
    ),
    "lifecycle_action": (
        [
            ("WINBACK", [("churn_risk_score", ">", 0.7)]),
            ("REWARD", [("total_orders", ">", 50)]),
        ],
        "ENGAGE",
    ),
}

# Label rules that stand in for a hosted model; the cuts are ours.
CUSTOMER_LABELS = {
    "persona": (
        [
            ("Risky COD Buyer", [("cod_pct", ">", 60)]),
            ("Discount Hunter", [("discount_sensitivity_score", ">", 0.6)]),
            ("Premium", [("avg_order_value", ">=", 25000)]),
        ],
        "Loyal Shopper",
    ),
    "fraud_risk_label": (
        [
            ("HIGH", [("fraud_risk_score", ">", 0.4)]),
            ("HIGH", [("cod_pct", ">", 60), ("return_rate_pct", ">", 25)]),
            ("MEDIUM", [("fraud_risk_score", ">", 0.2)]),
            ("MEDIUM", [("cod_pct", ">", 60)]),
            ("MEDIUM", [("return_rate_pct", ">", 25)]),
        ],
        "LOW",
    ),
    "rto_risk_label": (
        [
            ("HIGH", [("cod_pct", ">", 60), ("return_rate_pct", ">", 20)]),
            ("MEDIUM", [("cod_pct", ">", 40)]),
            ("MEDIUM", [("return_rate_pct", ">", 15)]),
        ],
        "LOW",
    ),
    "marketing_strategy": (
        [
            ("PAUSE_AND_REVIEW", [("marketing_roi", "<", 0)]),
            ("REDUCE_FREQUENCY", [("avg_fatigue_score", ">", 0.8)]),
            ("SCALE_WINNING_CAMPAIGNS", [("marketing_roi", ">=", 20)]),
            ("NURTURE_WITH_CONTENT", [("avg_engagement_score", ">", 0.5)]),
        ],
        "TEST_NEW_CHANNELS",
    ),
    "targeting_decision": (
        [
            ("avoid", [("marketing_roi", "<", 0)]),
            ("avoid", [("avg_fatigue_score", ">", 0.8)]),
            ("aggressive", [("marketing_roi", ">=", 10), ("avg_engagement_score", ">", 0.5)]),
        ],
        "moderate",
    ),
}

# Drivers reported as fraud reason codes (cuts are ours).
FRAUD_DRIVERS = [
    ("HIGH_FRAUD_SCORE", "fraud_risk_score", 0.4),
    ("HIGH_COD_SHARE", "cod_pct", 60.0),
    ("HIGH_RETURN_RATE", "return_rate_pct", 25.0),
]
CANCELLATION_DRIVER = ("MANY_CANCELLATIONS", "total_cancellations", 5.0)


def reason_codes(drivers) -> Column:
    """Comma separated names of the drivers above their cut, ``NONE`` if there are none."""
    codes = F.concat_ws(",", *[F.when(F.col(c) > cut, F.lit(name)) for name, c, cut in drivers])
    return F.when(codes == "", F.lit("NONE")).otherwise(codes)


def settlement_probability() -> Column:
    """Chance that an order is paid and kept; weights are ours."""
    loss = (
        or_zero(F.col("cod_pct")) / 100 * 0.4
        + or_zero(F.col("return_rate_pct")) / 100 * 0.4
        + F.col("total_cancellations") * 0.02
    )
    return F.round(clamp(1 - loss, 0.0, 1.0), 3)


def customer_actions() -> dict[str, Column]:
    actions = {name: ladder(rules, other) for name, (rules, other) in CUSTOMER_ACTIONS.items()}
    favourite = F.col("most_frequent_category")
    actions["personalization_action"] = F.coalesce(
        F.concat(F.lit("RECOMMEND_"), favourite), F.lit("GENERIC")
    )
    return actions


# Persona by share: a customer beyond this part of all others (cuts are ours).
PERSONA_SHARES = {"cod_pct": 0.9, "discount_sensitivity_score": 0.8, "avg_order_value": 0.8}
ACCURACY = 100_000  # of the quantile sketch: at most one rank in so many is wrong


def persona_cuts(gold: DataFrame, store: Store) -> dict[str, float | None]:
    """The value below which the given share of customers lies, for each measure; null without values.

    One mergeable quantile sketch for each measure in a single pass; the row of
    cuts is stored with the mart and read back, so labels are a plain projection.
    """
    cuts = [F.percentile_approx(c, F.lit(p), F.lit(ACCURACY)).alias(c) for c, p in PERSONA_SHARES.items()]
    return store.replace("persona_cuts", gold.agg(*cuts)).first().asDict()


def persona_by_share(cuts: dict[str, float | None]) -> Column:
    """Persona by the stored cuts; a measure without a cut decides nothing."""
    rules = [
        (label, [(measure, ">", cuts[measure])])
        for label, measure in (
            ("Risky COD Buyer", "cod_pct"),
            ("Discount Hunter", "discount_sensitivity_score"),
            ("Premium", "avg_order_value"),
        )
        if cuts[measure] is not None
    ]
    return ladder(rules, "Loyal Shopper") if rules else F.lit("Loyal Shopper")


def customer_labels() -> dict[str, Column]:
    labels = {name: ladder(rules, other) for name, (rules, other) in CUSTOMER_LABELS.items()}
    labels["fraud_reason"] = reason_codes(FRAUD_DRIVERS)
    labels["settlement_probability"] = settlement_probability()
    return labels


def customer_ai_360(gold: DataFrame, now: str) -> DataFrame:
    """Customer 360 plus labels, actions and the enrichment time."""
    return gold.withColumns(
        {
            **customer_labels(),
            **customer_actions(),
            "ai_enriched_at": F.lit(now).cast("timestamp_ntz"),
        }
    )


def identity_insights(gold: DataFrame) -> DataFrame:
    """Risk label and reasons per customer, including cancellations."""
    rules, other = CUSTOMER_LABELS["fraud_risk_label"]
    return gold.select(
        "customer_id",
        reason_codes([*FRAUD_DRIVERS, CANCELLATION_DRIVER]).alias("fraud_reason"),
        ladder(rules, other).alias("fraud_risk_label"),
    )


# Final seller decision, first matching row wins.
FINAL_ACTION = [
    ("RESTRICT_SELLER", [("risk_segment", "=", "High Risk")]),
    ("FIX_PRODUCT_QUALITY", [("actual_return_rate_pct", ">", 25)]),
    ("CHANGE_LOGISTICS", [("late_delivery_pct", ">", 20)]),
    ("STOP_MARKETING", [("marketing_roi", "<", 0)]),
    ("BOOST_SELLER", [("growth_segment", "=", "High Growth")]),
    ("PRIORITIZE_SELLER", [("performance_segment", "=", "Top Performer")]),
]
FINAL_ACTION_OTHER = "OPTIMIZE"

# Stand-ins for hosted-model labels on sellers; the cuts are ours.
SELLER_LABELS = {
    "seller_classification": (
        [
            ("Risky Seller", [("risk_segment", "=", "High Risk")]),
            ("Top Performer", [("performance_segment", "=", "Top Performer")]),
            ("Good Performer", [("performance_segment", "=", "Good Performer")]),
        ],
        "Average",
    ),
    "suggested_action": (
        [
            ("REDUCE_RETURNS", [("actual_return_rate_pct", ">", 20)]),
            ("SPEED_UP_DELIVERY", [("avg_delivery_days_actual", ">", 6)]),
            ("CUT_MARKETING_WASTE", [("marketing_roi", "<", 0)]),
            ("RECOVER_GROWTH", [("growth_rate_pct", "<", 0)]),
        ],
        "SCALE_CATALOGUE",
    ),
}

# Risk and strength drivers: (name, column, value that counts as 1.0).
RISK_DRIVERS = [("RETURNS", "actual_return_rate_pct", 25.0), ("FRAUD", "fraud_rate_pct", 5.0)]
STRENGTH_DRIVERS = [
    ("REVENUE", "total_order_value", 1000000.0),
    ("RATING", "avg_customer_rating_actual", 5.0),
    ("GROWTH", "growth_rate_pct", 45.0),
]


def largest_driver(drivers) -> Column:
    """Name of the driver with the largest normalised value; ties go to the later name."""
    scored = [
        F.struct((F.coalesce(F.col(c), F.lit(0.0)) / full).alias("s"), F.lit(name).alias("name"))
        for name, c, full in drivers
    ]
    return F.greatest(*scored)["name"]


# Fixed format of the seller summary line: label and column, in this order.
# Amounts and rates are written with two decimals.
CONTEXT_PARTS = [
    ("Seller Summary: Revenue=", "total_order_value"),
    (", Orders=", "total_orders_actual"),
    (", ReturnRate=", "actual_return_rate_pct"),
    (", COD=", "cod_pct"),
    (", Growth=", "growth_rate_pct"),
    (", ROI=", "marketing_roi"),
    (", Category=", "most_sold_category"),
    (", Rating=", "avg_customer_rating_actual"),
]
CONTEXT_AS_IS = {"total_orders_actual", "most_sold_category"}


def seller_context() -> Column:
    """Summary line; null as soon as one part is null."""
    parts = []
    for text, column in CONTEXT_PARTS:
        value = F.col(column)
        if column not in CONTEXT_AS_IS:
            value = value.cast("decimal(38,2)")
        parts += [F.lit(text), value.cast("string")]
    return F.concat(*parts)


def seller_labels() -> dict[str, Column]:
    """Sentiment, labels and drivers; they read segments, the profile and plain measures of orders only."""
    mood = F.concat_ws(" ", "performance_segment", "growth_segment")
    return {
        "performance_sentiment_score": sentiment(mood),
        **{name: ladder(rules, other) for name, (rules, other) in SELLER_LABELS.items()},
        "extracted_risk": largest_driver(RISK_DRIVERS),
        "extracted_strength": largest_driver(STRENGTH_DRIVERS),
    }


def seller_enriched(gold: DataFrame, now: str) -> DataFrame:
    """Seller 360 plus context line, labels, sentiment, drivers and final action."""
    return gold.withColumns(
        {
            "seller_context": seller_context(),
            **seller_labels(),
            "final_action": ladder(FINAL_ACTION, FINAL_ACTION_OTHER),
            "created_at_seller": F.lit(now).cast("timestamp_ntz"),
        }
    )


EMBEDDING_SIZE = 1024  # fixed value: vector length


def seller_text() -> Column:
    names = ("most_sold_category", "performance_segment", "growth_segment")
    return F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names])


def seller_embeddings(gold: DataFrame) -> DataFrame:
    """Unit-length hashed word vectors of category and segments.

    All three stages are stateless, so fitting reads no data.
    """
    text = gold.select("seller_id", seller_text().alias("text"))
    stages = Pipeline(
        stages=[
            Tokenizer(inputCol="text", outputCol="words"),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=EMBEDDING_SIZE),
            Normalizer(inputCol="tf", outputCol="vector", p=2.0),
        ]
    )
    return stages.fit(text).transform(text).select("seller_id", "text", "vector")


def embedding_arrays(vectors: DataFrame) -> DataFrame:
    return vectors.select(
        "seller_id", vector_to_array("vector", "float32").alias("seller_embedding")
    )
