"""Inventory risk per seller and product, and stock-out alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.exact import exact_avg
from souk.functions.ladders import ladder
from souk.functions.nulls import greatest_n
from souk.operators.joins import split_join

KEYS = ["seller_id", "product_id"]

# Levels by stock left after pending orders (cuts are ours).
RISK_LEVEL = [
    ("STOCKOUT", [("stock_after_pending", "<=", 0)]),
    ("CRITICAL", [("stock_after_pending", "<=", 3)]),
    ("WARNING", [("stock_after_pending", "<=", 10)]),
]


def inventory_risk(sold: DataFrame, sellers: DataFrame) -> DataFrame:
    """One row per (seller, product) with orders, over ``seller_orders``.

    Current stock is the level seen by the latest order; an order is pending
    while it is shipped or its payment is open.
    """
    c = F.col
    open_order = (F.lower("order_status") == "shipped") | (F.lower("payment_status") == "pending")
    per_product = sold.filter(c("product_id").isNotNull()).groupBy(*KEYS).agg(
        F.max_by(
            F.struct("stock_level_at_order", "product_name", "category"),
            F.struct("order_date", "order_id"),
        ).alias("latest"),
        F.count_if(open_order).alias("pending_orders"),
        exact_avg(c("order_value")).alias("avg_value"),
    )
    after = c("current_stock_level") - c("pending_orders")
    shortage = greatest_n(F.lit(0).cast("long"), -c("stock_after_pending"))
    names = sellers.select("seller_id", "seller_name")
    return (
        split_join(per_product, names, "seller_id", spread="product_id", counted=sold)
        .select(
            *KEYS,
            "seller_name",
            c("latest.product_name").alias("product_name"),
            c("latest.category").alias("category"),
            c("latest.stock_level_at_order").cast("long").alias("current_stock_level"),
            "pending_orders",
            "avg_value",
        )
        .withColumn("stock_after_pending", after)
        .withColumn("risk_level", ladder(RISK_LEVEL, "HEALTHY"))
        .withColumn("estimated_unfulfillable_orders", shortage)
        .withColumn(
            "potential_revenue_loss",
            F.round(c("estimated_unfulfillable_orders") * c("avg_value"), 2),
        )
        .drop("avg_value")
    )


def stockout_alerts(risk: DataFrame, previous: DataFrame | None, now: str) -> DataFrame:
    """Open alerts for products out of stock or nearly so.

    An alert keeps the time it was first raised while it stays open; one whose
    product has recovered is kept once more as CLOSED.
    """
    c = F.col
    current = risk.filter(c("risk_level").isin("STOCKOUT", "CRITICAL")).select(
        *KEYS,
        "seller_name",
        "product_name",
        "category",
        c("current_stock_level").alias("current_stock"),
        "pending_orders",
        "risk_level",
        c("estimated_unfulfillable_orders").alias("estimated_stockout_orders"),
        "potential_revenue_loss",
    )
    raised = F.lit(now).cast("timestamp_ntz")
    if previous is None:
        return current.withColumns({"alert_timestamp": raised, "alert_status": F.lit("OPEN")})
    was_open = previous.filter(c("alert_status") == "OPEN")
    details = [x for x in current.columns if x not in KEYS]
    both = current.alias("n").join(was_open.alias("p"), KEYS, "full_outer")
    still = c("n.risk_level").isNotNull()
    return both.select(
        *KEYS,
        *[F.when(still, c(f"n.{d}")).otherwise(c(f"p.{d}")).alias(d) for d in details],
        F.coalesce(c("p.alert_timestamp"), raised).alias("alert_timestamp"),
        F.when(still, F.lit("OPEN")).otherwise(F.lit("CLOSED")).alias("alert_status"),
    )
