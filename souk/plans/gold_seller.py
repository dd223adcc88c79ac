"""Seller 360: wide order fact, seller measures and derived segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.exact import exact_avg, exact_sum, weighted_avg
from souk.functions.ladders import ladder
from souk.functions.nulls import pct
from souk.operators.joins import known_keys, split_join
from souk.operators.profile import Profile, distinct_counts, value_profile

KEY = "seller_id"


def customer_seller_mapping(
    orders: DataFrame, customers: DataFrame, seller_count: Column, first_seller: int = 0
) -> DataFrame:
    """Bridge order -> seller: sellers take orders in turn by order id."""
    rows = orders.select("customer_id", "order_id", "product_id", "category")
    placed = in_turn(rows, customers, seller_count, first_seller)
    return placed.select("customer_id", "order_id", "product_id", "category", KEY)


def in_turn(orders: DataFrame, customers: DataFrame, seller_count: Column, first_seller: int = 0) -> DataFrame:
    """Orders of known customers, of any columns, with the seller whose turn it is by order id."""
    seller = F.col("order_id") % seller_count + F.lit(first_seller)
    known = known_keys(orders, customers, "customer_id", spread="order_id")
    return known.select(*orders.columns, seller.cast("long").alias(KEY))


# Wide order fact: columns taken from each side, as name or name:new_name.
FACT_ORDER = """order_id order_date product_id product_name brand category sub_category
    quantity unit_price order_value discount_amount payment_type payment_status
    order_status delivery_partner delivery_time_days is_returned is_cancelled cod_flag
    customer_rating:order_rating high_rto_risk_flag fraud_flag margin profit""".split()
FACT_CUSTOMER = """customer_id gender age city:customer_city state:customer_state
    loyalty_tier loyalty_points customer_type preferred_payment_method preferred_category
    total_orders:customer_total_orders customer_lifetime_value discount_sensitivity_score
    price_sensitivity_score return_behavior_score fraud_risk_score:customer_fraud_risk
    churn_risk_score engagement_score""".split()
FACT_SELLER = """seller_id seller_name seller_type seller_category seller_tier seller_city
    seller_state years_on_platform total_orders:seller_total_orders
    total_revenue:seller_total_revenue avg_order_value:seller_avg_order_value
    growth_rate_pct repeat_customer_pct avg_customer_rating:seller_avg_rating
    return_rate_pct:seller_return_rate cancellation_rate_pct:seller_cancel_rate
    rto_rate_pct:seller_rto_rate fulfillment_type top_delivery_partner:seller_top_partner
    marketing_roi seller_score seller_risk_score is_top_seller is_high_return_seller
    is_high_risk_seller""".split()


def _renamed(spec: list[str]) -> list[Column]:
    out = []
    for entry in spec:
        old, _, new = entry.partition(":")
        out.append(F.col(old).alias(new or old))
    return out


def order_fact(
    orders: DataFrame, customers: DataFrame, mapping: DataFrame, sellers: DataFrame
) -> DataFrame:
    """Order x customer x seller, one row per mapped order.

    Customer and seller keys can be very unevenly used, so both dimension
    joins split hot keys; the order-mapping join is on the unique order id.
    """
    order_side = orders.select("customer_id", *_renamed(FACT_ORDER))
    customer_side = customers.select(
        F.concat("first_name", F.lit(" "), "last_name").alias("customer_name"),
        *_renamed(FACT_CUSTOMER),
    )
    seller_side = sellers.select(*_renamed(FACT_SELLER))
    mapped = order_side.join(mapping.select("order_id", KEY), "order_id")
    with_customer = split_join(
        mapped, customer_side, "customer_id", spread="order_id", counted=orders
    )
    wide = split_join(with_customer, seller_side, KEY, spread="order_id", counted=mapping)
    return wide.select(*order_fact_columns())


def order_fact_columns() -> list[str]:
    names = [(e.partition(":")[2] or e.partition(":")[0]) for e in FACT_ORDER]
    customer = [(e.partition(":")[2] or e.partition(":")[0]) for e in FACT_CUSTOMER]
    seller = [(e.partition(":")[2] or e.partition(":")[0]) for e in FACT_SELLER]
    return [*names, customer[0], "customer_name", *customer[1:], *seller]


SELLER_ORDER_COLUMNS = """order_id customer_id order_value discount_amount order_date quantity
    category brand product_id product_name is_returned is_cancelled refund_amount cod_flag
    payment_type payment_status order_status delivery_time_days customer_rating
    stock_level_at_order high_rto_risk_flag fraud_flag margin profit""".split()


def seller_orders(orders: DataFrame, mapping: DataFrame) -> DataFrame:
    """Orders with their seller.  Read several times below, so worth storing once."""
    return with_seller(orders.select(SELLER_ORDER_COLUMNS), mapping)


def with_seller(orders: DataFrame, mapping: DataFrame) -> DataFrame:
    """Orders of any columns, also such as are stored before the others are mapped, with their seller."""
    return orders.join(mapping.select("order_id", KEY), "order_id")


def seller_order_measures(sold: DataFrame) -> DataFrame:
    """Order measures that one pass adds up, one row per seller, over ``seller_orders``."""
    n = F.count("*")
    payment = F.lower("payment_type")
    value, profit = exact_sum(F.col("order_value")), exact_sum(F.col("profit"))
    return sold.groupBy(KEY).agg(
        n.alias("total_orders_actual"),
        value.alias("total_order_value"),
        exact_sum(F.col("discount_amount")).alias("total_discount_given"),
        exact_avg(F.col("order_value")).alias("avg_order_value"),
        F.max("order_value").alias("max_order_value"),
        F.min("order_value").alias("min_order_value"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.date_diff(F.max("order_date"), F.min("order_date")).alias("order_span_days"),
        F.sum("quantity").alias("total_items_sold"),
        F.avg("quantity").alias("avg_items_per_order"),
        F.count_if("is_returned").alias("total_returns"),
        F.count_if("is_cancelled").alias("total_cancellations"),
        exact_sum(F.col("refund_amount")).alias("total_refund_amount"),
        pct(F.count_if("is_returned"), n).alias("actual_return_rate_pct"),
        pct(F.count_if("is_cancelled"), n).alias("actual_cancel_rate_pct"),
        F.count_if("cod_flag").alias("cod_orders"),
        F.count_if(payment == "upi").alias("upi_orders"),
        F.count_if(payment.isin("card", "credit card", "debit card")).alias("card_orders"),
        F.count_if(payment == "wallet").alias("wallet_orders"),
        pct(F.count_if("cod_flag"), n).alias("cod_pct"),
        F.count_if(F.lower("order_status") == "delivered").alias("delivered_orders"),
        F.avg("delivery_time_days").alias("avg_delivery_days_actual"),
        F.avg("customer_rating").alias("avg_customer_rating_actual"),
        F.count_if("high_rto_risk_flag").alias("high_rto_risk_orders"),
        F.count_if("fraud_flag").alias("fraud_flagged_orders"),
        exact_sum(F.col("margin")).alias("total_margin"),
        profit.alias("total_profit"),
        # Mean margin amount, kept under its historical name.
        F.round(exact_avg(F.col("margin")), 2).alias("avg_margin_pct"),
        F.round(profit / F.nullif(value, F.lit(0.0)) * 100, 2).alias("profit_margin_pct"),
    )


def seller_order_metrics(sold: DataFrame) -> DataFrame:
    """Order measures and distinct counts, one row per seller, over ``seller_orders``."""
    measures = seller_order_measures(sold)
    few = value_profile(
        sold,
        KEY,
        Profile(
            distincts={"unique_categories_sold": "category", "unique_brands_sold": "brand"},
        ),
    )
    many = distinct_counts(
        sold,
        KEY,
        {
            "unique_orders": "order_id",
            "unique_customers": "customer_id",
            "unique_products_sold": "product_id",
        },
    )
    return measures.join(few, KEY, "left").join(many, KEY, "left").fillna(
        0, ["unique_categories_sold", "unique_brands_sold"]
    )


def seller_top_values(sold: DataFrame) -> DataFrame:
    """Most sold category and brand and most used payment per seller.

    One pass for all three instead of three joins and three windows; a
    missing category counts as a value of its own.
    """
    spec = Profile(
        modes={
            "most_sold_category": "category",
            "most_sold_brand": "brand",
            "preferred_payment_type": "payment_type",
        },
        null_is_value=True,
    )
    return value_profile(sold, KEY, spec)


def seller_customer_metrics(
    customers: DataFrame, mapping: DataFrame, per_customer: bool = False, counted: str | None = None
) -> DataFrame:
    """Customer mix per seller.

    Averages and tier counts are weighted by mapping rows, so the high-value
    percentage can exceed 100; ``per_customer=True`` counts each customer of a
    seller once instead.  The mapping is first reduced to (seller, customer)
    pairs, which keeps the customer join free of repeated rows; ``counted``
    names a column of such pairs that already has their number.
    """
    rows = F.sum(counted) if counted else F.count("*")
    pairs = mapping.groupBy(KEY, "customer_id").agg(rows.alias("n"))
    if per_customer:
        pairs = pairs.withColumn("n", F.lit(1).cast("long"))
    scores = {
        "avg_customer_clv": "customer_lifetime_value",
        "avg_customer_churn_risk": "churn_risk_score",
        "avg_customer_engagement": "engagement_score",
        "avg_customer_fraud_risk": "fraud_risk_score",
        "avg_discount_sensitivity": "discount_sensitivity_score",
        "avg_price_sensitivity": "price_sensitivity_score",
    }
    tier, n = F.lower("loyalty_tier"), F.col("n")
    rows_in = lambda test: F.sum(F.when(test, n).otherwise(0))
    people = customers.select("customer_id", "loyalty_tier", *scores.values())
    return (
        pairs.join(people, "customer_id")
        .groupBy(KEY)
        .agg(
            F.count("*").alias("total_customers_served"),
            *[weighted_avg(F.col(c), n).alias(out) for out, c in scores.items()],
            *[
                rows_in(tier == t).alias(f"{t}_customers")
                for t in ("platinum", "gold", "silver", "bronze")
            ],
            pct(rows_in(tier.isin("platinum", "gold")), F.count("*")).alias(
                "high_value_customer_pct_actual"
            ),
        )
    )


# Derived segments, first matching row wins.
RISK_SEGMENT = [
    ("High Risk", [("seller_risk_score", ">=", 70)]),
    ("High Risk", [("is_high_risk_seller", "is", True)]),
    ("Medium Risk", [("seller_risk_score", ">=", 40)]),
]
PERFORMANCE_SEGMENT = [
    ("Top Performer", [("seller_score", ">=", 80), ("is_top_seller", "is", True)]),
    ("Good Performer", [("seller_score", ">=", 60)]),
    ("Average Performer", [("seller_score", ">=", 40)]),
]
GROWTH_SEGMENT = [
    ("High Growth", [("growth_rate_pct", ">=", 30)]),
    ("Moderate Growth", [("growth_rate_pct", ">=", 10)]),
    ("Stable", [("growth_rate_pct", ">=", 0)]),
]
SEGMENTS = {
    "risk_segment": (RISK_SEGMENT, "Low Risk"),
    "performance_segment": (PERFORMANCE_SEGMENT, "Needs Improvement"),
    "growth_segment": (GROWTH_SEGMENT, "Declining"),
}

# Seller profile columns that get another name because a measured twin exists.
RENAMED = {
    "total_orders": "profile_total_orders",
    "total_revenue": "profile_total_revenue",
    "avg_order_value": "profile_avg_order_value",
    "monthly_sales": "profile_monthly_sales",
    "return_rate_pct": "profile_return_rate",
    "cancellation_rate_pct": "profile_cancel_rate",
    "avg_delivery_days": "profile_avg_delivery_days",
    "avg_customer_rating": "profile_avg_rating",
    "unique_customers_served": "profile_unique_customers",
    "customer_lifetime_value_avg": "profile_customer_clv",
    "high_value_customer_pct": "profile_high_value_pct",
}


def gold_seller_360(
    sellers: DataFrame,
    order_metrics: DataFrame,
    customer_metrics: DataFrame,
    top_values: DataFrame,
    as_of: str,
    now: str,
) -> DataFrame:
    """One row per seller; measures stay null for sellers without orders."""
    joined = (
        _profile(sellers).join(order_metrics, KEY, "left")
        .join(customer_metrics, KEY, "left")
        .join(top_values, KEY, "left")
    )
    return _derived(joined, as_of, now)


def seller_measures_360(sellers: DataFrame, measures: DataFrame, as_of: str, now: str) -> DataFrame:
    """The seller 360 without distinct counts, customer mix and top values, none of which labels read."""
    return _derived(_profile(sellers).join(measures, KEY, "left"), as_of, now)


def _profile(sellers: DataFrame) -> DataFrame:
    return sellers.select(*[F.col(c).alias(RENAMED.get(c, c)) for c in sellers.columns])


def _derived(joined: DataFrame, as_of: str, now: str) -> DataFrame:
    segments = {name: ladder(rules, default) for name, (rules, default) in SEGMENTS.items()}
    return joined.withColumns(
        {
            "seller_tenure_days": F.date_diff(F.lit(as_of).cast("date"), "seller_onboard_date"),
            "product_active_pct": pct(F.col("active_products"), F.col("total_products_listed")),
            "fraud_rate_pct": pct(F.col("fraud_flagged_orders"), F.col("total_orders_actual")),
            **segments,
            "created_at": F.lit(now).cast("timestamp_ntz"),
        }
    )
