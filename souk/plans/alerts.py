"""Alert rules, alert details, report lines and the alert board."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.exact import exact_sum
from souk.operators.topk import as_rows, top_k

# Tiers from best to worst, alert names in report order.
TIER_RANK = {"platinum": 4, "gold": 3, "silver": 2, "bronze": 1}
ALERTS = [
    (1, "Seller Fraud"),
    (2, "Customer Churn"),
    (3, "Critical Retention"),
    (4, "Seller Risk Escalation"),
    (5, "Tier Downgrades"),
    (6, "Ops Health Crisis"),
    (7, "High RTO / Logistics"),
    (8, "Campaign Re-targeting"),
    (9, "Inventory Stock-Out"),
    (10, "COD Payment Risk"),
    (11, "Low Sustainability"),
]

# Thresholds of the alerts.
FRAUD_RATE, RTO_RATE, STOCK_OUT, COD_USERS = 5, 10, 15, 60
UPSELL, SUSTAINABILITY, BIG_REVENUE = 0.5, 0.4, 100000

high_churn = lambda: F.col("churn_prediction_30d").isin("VERY HIGH", "HIGH")
critical = lambda: F.col("retention_priority") == "CRITICAL"
high_risk = lambda: F.col("risk_forecast").isin("CRITICAL", "HIGH")
retarget = lambda: (F.col("persona_stability") == "LIKELY SHIFTING") & (
    F.col("upsell_potential_score") > UPSELL
)
unsustainable = lambda: (F.col("sustainability_score") < SUSTAINABILITY) & (
    F.col("current_revenue") > BIG_REVENUE
)


def tier_rank(name: str) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in TIER_RANK.items() for x in pair])
    return F.try_element_at(ranks, F.col(name))


def downgraded(current: str, predicted: str, strict: bool = False) -> Column:
    """Predicted tier below the current one.

    The alert only looks at platinum and gold; ``strict`` also reports a drop
    from silver to bronze.
    """
    watched = tier_rank(current) >= (2 if strict else 3)
    return watched & (tier_rank(predicted) < tier_rank(current))


def _at_risk(test: Column) -> Column:
    total = exact_sum(F.when(test, F.col("revenue_at_risk")))
    return F.round(F.coalesce(total, F.lit(0.0)), 0)


def _counts(**named: Column) -> list[Column]:
    return [c.alias(name) for name, c in named.items()]


def seller_counts(sellers: DataFrame) -> DataFrame:
    """All seller-table alert counts in one scan."""
    c = F.col
    return sellers.agg(
        *_counts(
            a1=F.count_if(c("fraud_flag_rate") > FRAUD_RATE),
            a7=F.count_if(c("rto_rate_pct") > RTO_RATE),
            a9=F.count_if(c("stock_out_rate") > STOCK_OUT),
            a10=F.count_if(c("cod_users_pct") > COD_USERS),
        )
    )


def customer_counts(forecast: DataFrame, strict: bool = False) -> DataFrame:
    drop = downgraded("current_loyalty_tier", "predicted_loyalty_tier", strict)
    return forecast.agg(
        *_counts(
            a2=F.count_if(high_churn()),
            r2=_at_risk(high_churn()),
            a3=F.count_if(critical()),
            r3=_at_risk(critical()),
            a5c=F.count_if(drop),
            a8=F.count_if(retarget()),
        )
    )


def seller_forecast_counts(forecast: DataFrame, strict: bool = False) -> DataFrame:
    drop = downgraded("current_seller_tier", "predicted_seller_tier", strict)
    return forecast.agg(
        *_counts(
            a4=F.count_if(high_risk()),
            r4=_at_risk(high_risk()),
            a5s=F.count_if(drop),
            a6=F.count_if(F.col("operational_health_forecast") == "AT RISK"),
            a11=F.count_if(unsustainable()),
        )
    )


def alerts(
    sellers: DataFrame,
    customer_forecast: DataFrame,
    seller_forecast: DataFrame,
    strict: bool = False,
) -> DataFrame:
    """One row per alert: id, name, triggered count and revenue at risk.

    The tier alert watches customers and sellers; it has a count of each.

    Three one-row aggregates (one scan per table) are turned into rows.
    """
    frames = [
        seller_counts(sellers),
        customer_counts(customer_forecast, strict),
        seller_forecast_counts(seller_forecast, strict),
    ]
    counts = reduce(
        DataFrame.unionByName,
        [as_rows(f.select(*[F.col(x).cast("double") for x in f.columns]), "key", "v") for f in frames],
    )
    kind = F.substring("key", 1, 1)
    rows = counts.select(
        F.regexp_extract("key", "([0-9]+)", 1).cast("int").alias("alert_id"),
        F.when(kind == "a", F.col("v").cast("long")).alias("n"),
        F.when(kind == "r", F.col("v")).alias("risk"),
        F.when(F.col("key") == "a5c", F.col("v")).cast("long").alias("people"),
        F.when(F.col("key") == "a5s", F.col("v")).cast("long").alias("sellers"),
    )
    names = F.create_map(*[F.lit(x) for pair in ALERTS for x in pair])
    return rows.groupBy("alert_id").agg(
        F.sum("n").alias("triggered_count"),
        F.max("risk").alias("revenue_at_risk"),
        F.max("people").alias("customers_downgraded"),
        F.max("sellers").alias("sellers_downgraded"),
    ).select(
        "alert_id",
        F.element_at(names, F.col("alert_id")).alias("alert_name"),
        "triggered_count",
        "revenue_at_risk",
        "customers_downgraded",
        "sellers_downgraded",
    )


def fired(alert_rows: DataFrame) -> DataFrame:
    """Number of alerts that fired, with the closing message."""
    n = F.count_if(F.col("triggered_count") > 0)
    message = F.when(n > 0, F.concat(n.cast("string"), F.lit(" alerts"))).otherwise(
        F.lit("nothing to report")
    )
    return alert_rows.agg(n.alias("alerts_fired"), message.alias("message"))


# -- details -----------------------------------------------------------------


def fraud_details(sellers: DataFrame) -> DataFrame:
    hits = sellers.filter(F.col("fraud_flag_rate") > FRAUD_RATE)
    return top_k(hits, "fraud_flag_rate", 10, "seller_id").select(
        "seller_id",
        "seller_name",
        "seller_category",
        "fraud_flag_rate",
        "rto_rate_pct",
        "cancellation_rate_pct",
        F.round("total_revenue", 0).alias("total_revenue"),
    )


def churn_details(forecast: DataFrame) -> DataFrame:
    return top_k(forecast.filter(high_churn()), "revenue_at_risk", 10, "customer_id").select(
        "customer_id",
        "customer_name",
        F.coalesce("persona", F.lit("N/A")).alias("persona"),
        "churn_prediction_30d",
        F.round("revenue_at_risk", 0).alias("revenue_at_risk"),
        F.coalesce("recommended_intervention", F.lit("N/A")).alias("recommended_intervention"),
    )


def seller_risk_details(forecast: DataFrame) -> DataFrame:
    return top_k(forecast.filter(high_risk()), "revenue_at_risk", 10, "seller_id").select(
        "seller_id",
        "seller_name",
        "seller_category",
        "risk_forecast",
        F.round("operational_health_score", 1).alias("operational_health_score"),
        F.round("revenue_at_risk", 0).alias("revenue_at_risk"),
        "recommended_action",
    )


def stock_out_details(sellers: DataFrame) -> DataFrame:
    hits = sellers.filter(F.col("stock_out_rate") > STOCK_OUT)
    return top_k(hits, "stock_out_rate", 10, "seller_id").select(
        "seller_id",
        "seller_name",
        "seller_category",
        F.round("stock_out_rate", 1).alias("stock_out_rate"),
        F.round("inventory_turnover_ratio", 2).alias("inventory_turnover_ratio"),
        "avg_stock_level",
    )


def report_text(details: DataFrame, measure: str, tie: str, columns: list[str]) -> DataFrame:
    """All detail lines as one text, highest measure first (at most ten rows)."""
    line = F.concat(F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit("; "))
    ordered = f"listagg(line, '') WITHIN GROUP (ORDER BY {measure} DESC, {tie})"
    return details.withColumn("line", line).agg(F.expr(ordered).alias("report"))


# -- board -------------------------------------------------------------------

# The twenty board lines, in order.
BOARD = """Seller Fraud (>5%)
Customer Churn (HIGH+)
Critical Retention
Predictions Changed (Customers)
Seller Risk (HIGH+)
Seller Predictions Changed
Ops Health AT RISK
High RTO (>10%)
Inventory Stock-Out (>15%)
COD Dependency (>60%)
Low Sustainability (<0.4)
Inventory Stockout (Products)
Inventory Critical (Products)
Unfulfillable Orders (Stock Risk)
Revenue At Risk ($)
Avg Days to Stockout
Warning to Critical Soon (Stock < 5)
Categories Affected by Stockout
Sellers with 3+ Stockout Products
Open Inventory Alerts""".split("\n")


def alert_board(
    sellers: DataFrame,
    seller_forecast: DataFrame,
    customer_live: DataFrame,
    seller_live: DataFrame,
    inventory: DataFrame,
    stock_alerts: DataFrame,
) -> DataFrame:
    """Twenty lines from one conditional aggregate per source table."""
    c = F.col
    level = c("risk_level")
    short = level.isin("STOCKOUT", "CRITICAL")
    days_left = F.when(
        level.isin("WARNING", "CRITICAL") & (c("pending_orders") > 0),
        c("current_stock_level") / F.nullif(c("pending_orders"), F.lit(0)),
    )
    bad_sellers = (
        inventory.filter(level == "STOCKOUT").groupBy("seller_id").count().filter(c("count") >= 3)
    )
    parts = [
        seller_counts(sellers).toDF("1", "8", "9", "10"),
        customer_live.agg(
            F.count_if(c("realtime_churn_prediction").isin("VERY HIGH", "HIGH")).alias("2"),
            F.count_if(c("realtime_retention_priority") == "CRITICAL").alias("3"),
            F.count_if("prediction_changed").alias("4"),
        ),
        seller_live.agg(
            F.count_if(c("realtime_risk_forecast").isin("CRITICAL", "HIGH")).alias("5"),
            F.count_if("prediction_changed").alias("6"),
        ),
        seller_forecast.agg(
            F.count_if(c("operational_health_forecast") == "AT RISK").alias("7"),
            F.count_if(unsustainable()).alias("11"),
        ),
        inventory.agg(
            F.count_if(level == "STOCKOUT").alias("12"),
            F.count_if(level == "CRITICAL").alias("13"),
            F.sum(F.when(short, c("estimated_unfulfillable_orders"))).alias("14"),
            F.round(exact_sum(F.when(short, c("potential_revenue_loss"))), 0).alias("15"),
            # Ratios are added in whole millionths: the order of rows does not matter.
            F.round(
                F.sum(F.rint(days_left * 1e6).cast("long")) / F.lit(1e6)
                / F.nullif(F.count(days_left), F.lit(0)),
                1,
            ).alias("16"),
            F.count_if((level == "WARNING") & (c("stock_after_pending") < 5)).alias("17"),
            F.count_distinct(F.when(short, c("category"))).alias("18"),
        ),
        bad_sellers.agg(F.count("*").alias("19")),
        stock_alerts.agg(F.count_if(c("alert_status") == "OPEN").alias("20")),
    ]
    rows = reduce(
        DataFrame.unionByName,
        [as_rows(p.select(*[c(x).cast("double") for x in p.columns]), "line", "count") for p in parts],
    )
    names = F.array(*[F.lit(x) for x in BOARD])
    line = c("line").cast("int")
    return rows.select(line.alias("line"), F.element_at(names, line).alias("alert"), "count")
