"""Fixed dashboard reports and business questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.exact import exact_avg, exact_sum, units
from souk.operators.joins import split_join
from souk.operators.topk import chosen, distribution, top_k
from souk.plans.alerts import downgraded


def _whole(column: str, out: str) -> Column:
    return F.round(column, 0).alias(out)


def _sum0(column: str, out: str) -> Column:
    return F.round(exact_sum(F.col(column)), 0).alias(out)


def _avg(column: str, places: int, out: str) -> Column:
    return F.round(exact_avg(F.col(column)), places).alias(out)


def full_name() -> Column:
    return F.concat("first_name", F.lit(" "), "last_name")


# -- customers ---------------------------------------------------------------


def customer_totals(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.count("*").alias("total_customers"),
        F.count_distinct("loyalty_tier").alias("tiers"),
        _avg("customer_lifetime_value", 2, "avg_clv"),
    )


def customers_by_tier(customers: DataFrame) -> DataFrame:
    rows = distribution(
        customers, "loyalty_tier", "loyalty_tier", _avg("customer_lifetime_value", 2, "avg_clv")
    )
    return rows.orderBy(F.col("count").desc(), "loyalty_tier")


def top_customers(customers: DataFrame, k: int = 10) -> DataFrame:
    return top_k(customers, "customer_lifetime_value", k, "customer_id").select(
        "customer_id",
        full_name().alias("name"),
        "city",
        "loyalty_tier",
        "total_orders",
        F.round("customer_lifetime_value", 2).alias("clv"),
    )


def tier_category_value(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy("seller_tier", "category")
        .agg(F.count("*").alias("orders"), _sum0("order_value", "total_value"))
        .orderBy(F.col("total_value").desc(), "seller_tier", "category")
    )


def customer_forecast_kpis(forecast: DataFrame) -> DataFrame:
    c = F.col
    return forecast.agg(
        F.count("*").alias("total_customers"),
        F.count_if(c("churn_prediction_30d").isin("VERY HIGH", "HIGH")).alias("high_churn_count"),
        _avg("churn_probability_score", 3, "avg_churn_prob"),
        _sum0("revenue_at_risk", "total_revenue_at_risk"),
        F.count_if(c("current_loyalty_tier") != c("predicted_loyalty_tier")).alias(
            "tier_migration_count"
        ),
        F.count_if(c("retention_priority") == "CRITICAL").alias("critical_count"),
    )


def by_count(df: DataFrame, column: str, label: str) -> DataFrame:
    return distribution(df, column, label).orderBy(F.col("count").desc(), label)


def tier_migrations(forecast: DataFrame, k: int = 10) -> DataFrame:
    moved = forecast.filter(F.col("current_loyalty_tier") != F.col("predicted_loyalty_tier"))
    named = moved.withColumn(
        "migration", F.concat("current_loyalty_tier", F.lit(" -> "), "predicted_loyalty_tier")
    )
    return top_k(distribution(named, "migration", "migration"), "count", k, "migration")


def interventions(forecast: DataFrame) -> DataFrame:
    rows = distribution(
        forecast,
        "recommended_intervention",
        "intervention",
        _sum0("revenue_at_risk", "total_revenue_at_risk"),
    )
    return rows.orderBy(F.col("total_revenue_at_risk").desc(), "intervention")


def customer_forecast_detail(forecast: DataFrame, priority: str = "ALL", k: int = 50) -> DataFrame:
    hits = chosen(forecast, "retention_priority", priority)
    return top_k(hits, "revenue_at_risk", k, "customer_id").select(
        "customer_id",
        "customer_name",
        "persona",
        "current_loyalty_tier",
        "predicted_loyalty_tier",
        "current_rfm_segment",
        "predicted_rfm_segment",
        "churn_prediction_30d",
        F.round("churn_probability_score", 2).alias("churn_prob"),
        _whole("current_clv", "current_clv"),
        _whole("projected_clv_90d", "projected_clv_90d"),
        _whole("revenue_at_risk", "revenue_at_risk"),
        "retention_priority",
        "recommended_intervention",
    )


# -- sellers -----------------------------------------------------------------


def seller_forecast_kpis(forecast: DataFrame) -> DataFrame:
    c = F.col
    return forecast.agg(
        F.count("*").alias("total_sellers"),
        F.count_if(c("risk_forecast").isin("CRITICAL", "HIGH")).alias("high_risk_count"),
        _sum0("revenue_at_risk", "total_revenue_at_risk"),
        _avg("sustainability_score", 3, "avg_sustainability"),
        F.count_if(c("current_seller_tier") != c("predicted_seller_tier")).alias(
            "tier_migration_count"
        ),
        F.count_if(c("investment_recommendation") == "INVEST HEAVILY").alias("invest_count"),
    )


def growth_trends(forecast: DataFrame) -> DataFrame:
    rows = distribution(
        forecast,
        "revenue_growth_trend",
        "trend",
        _avg("projected_revenue_90d", 0, "avg_projected_rev"),
    )
    return rows.orderBy(F.col("avg_projected_rev").desc(), "trend")


def seller_actions(forecast: DataFrame) -> DataFrame:
    rows = distribution(
        forecast,
        "recommended_action",
        "action",
        _sum0("revenue_at_risk", "total_revenue_at_risk"),
        _avg("sustainability_score", 3, "avg_sustainability"),
    )
    return rows.orderBy(F.col("total_revenue_at_risk").desc(), "action")


def seller_forecast_detail(forecast: DataFrame, risk: str = "ALL", k: int = 50) -> DataFrame:
    hits = chosen(forecast, "risk_forecast", risk)
    return top_k(hits, "revenue_at_risk", k, "seller_id").select(
        "seller_id",
        "seller_name",
        "seller_type",
        "seller_category",
        "current_seller_tier",
        "predicted_seller_tier",
        _whole("current_revenue", "current_revenue"),
        _whole("projected_revenue_90d", "projected_rev_90d"),
        "revenue_growth_trend",
        "risk_forecast",
        F.round("operational_health_score", 1).alias("ops_health"),
        "profit_trajectory",
        F.round("sustainability_score", 2).alias("sustainability"),
        _whole("revenue_at_risk", "revenue_at_risk"),
        "investment_recommendation",
        "recommended_action",
    )


def top_sellers_by_rating(sellers: DataFrame, k: int = 10) -> DataFrame:
    return top_k(sellers, "avg_customer_rating", k, "seller_id").select(
        "seller_id", "seller_name", "seller_tier", "seller_category", "avg_customer_rating",
        "total_orders", "total_revenue", "seller_score",
    )


def top_sellers_by_orders(sellers: DataFrame, k: int = 10) -> DataFrame:
    return top_k(sellers, "total_orders", k, "seller_id").select(
        "seller_id", "seller_name", "seller_tier", "seller_category", "total_orders",
        "total_revenue", "repeat_customer_pct", "seller_score",
    )


def seller_kpis_by_tier(sellers: DataFrame) -> DataFrame:
    return (
        sellers.groupBy("seller_tier")
        .agg(
            F.count("*").alias("seller_count"),
            _avg("total_revenue", 2, "avg_revenue"),
            F.round(F.avg("total_orders"), 0).alias("avg_orders"),
            _avg("avg_customer_rating", 2, "avg_rating"),
            _avg("seller_score", 2, "avg_seller_score"),
            F.count_if("is_top_seller").alias("top_sellers_count"),
        )
        .orderBy(F.col("avg_revenue").desc(), "seller_tier")
    )


def sellers_named(sellers: DataFrame, names: list[str], k: int = 20) -> DataFrame:
    hits = sellers.filter(F.col("seller_name").isin(names))
    return hits.orderBy("seller_id").limit(k).select(
        "seller_id", "seller_name", "seller_tier", "seller_category", "seller_type",
        "total_revenue", "total_orders", "avg_order_value", "seller_score",
        "avg_customer_rating", "return_rate_pct", "cancellation_rate_pct", "fraud_flag_rate",
    )


# -- live --------------------------------------------------------------------


def stream_totals(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("total_events"),
        F.min("event_timestamp").alias("first_event"),
        F.max("event_timestamp").alias("last_event"),
    )


def live_stats(events: DataFrame, orders: DataFrame) -> DataFrame:
    """One row from scalar subqueries over two tables."""
    seen = events.agg(
        F.count("*").alias("total_events"), F.max("event_timestamp").alias("last_event")
    )
    return seen.withColumn("total_orders", orders.agg(F.count("*")).scalar())


def changed_totals(live: DataFrame) -> DataFrame:
    return live.agg(
        F.count("*").alias("total"), F.count_if("prediction_changed").alias("predictions_changed")
    )


def activity_peak(activity: DataFrame) -> DataFrame:
    return activity.agg(
        F.count("*").alias("keys"), F.max("recent_order_value").alias("max_order_value")
    )


def changed_customers(live: DataFrame, k: int = 10) -> DataFrame:
    return top_k(live.filter("prediction_changed"), "realtime_clv", k, "customer_id").select(
        "customer_id",
        "customer_name",
        F.col("baseline_churn_prediction").alias("before"),
        F.col("realtime_churn_prediction").alias("now"),
        _whole("realtime_clv", "realtime_clv"),
        F.col("realtime_retention_priority").alias("priority"),
    )


def changed_sellers(live: DataFrame, k: int = 10) -> DataFrame:
    return top_k(live.filter("prediction_changed"), "realtime_order_value", k, "seller_id").select(
        "seller_id",
        "seller_name",
        F.col("baseline_risk_forecast").alias("before"),
        F.col("realtime_risk_forecast").alias("now"),
        _whole("realtime_revenue", "realtime_rev"),
        F.col("realtime_order_count").alias("new_orders"),
    )


def watch_customers(live: DataFrame, k: int = 20) -> DataFrame:
    hits = live.filter("prediction_changed")
    return top_k(hits, "realtime_order_value", k, "customer_id").select(
        "customer_id", "customer_name", "baseline_churn_prediction", "realtime_churn_prediction",
        "baseline_clv", "realtime_clv", "realtime_order_count", "realtime_order_value",
        "prediction_changed",
    )


def watch_sellers(live: DataFrame, k: int = 20) -> DataFrame:
    hits = live.filter("prediction_changed")
    return top_k(hits, "realtime_order_value", k, "seller_id").select(
        "seller_id", "seller_name", "baseline_risk_forecast", "realtime_risk_forecast",
        "baseline_revenue", "realtime_revenue", "realtime_order_count", "realtime_order_value",
        "realtime_revenue_lift_pct", "prediction_changed",
    )


# -- inventory and platforms -------------------------------------------------


def inventory_summary(risk: DataFrame) -> DataFrame:
    return (
        risk.groupBy("risk_level")
        .agg(
            F.count("*").alias("products"),
            F.sum("estimated_unfulfillable_orders").alias("unfulfillable_orders"),
            _sum0("potential_revenue_loss", "revenue_at_risk"),
        )
        .orderBy("risk_level")
    )


def open_stock_alerts(alerts: DataFrame, k: int = 50) -> DataFrame:
    """Latest open alerts; equal times go by loss, then product and seller."""
    return (
        alerts.filter(F.col("alert_status") == "OPEN")
        .orderBy(
            F.col("alert_timestamp").desc(),
            F.col("potential_revenue_loss").desc(),
            "product_id",
            "seller_id",
        )
        .limit(k)
        .select(
            "alert_timestamp", "seller_name", "product_id", "product_name", "category",
            "current_stock", "pending_orders", "risk_level", "estimated_stockout_orders",
            _whole("potential_revenue_loss", "revenue_loss"), "alert_status",
        )
    )


def at_risk_by_category(risk: DataFrame) -> DataFrame:
    return (
        risk.filter(F.col("risk_level").isin("STOCKOUT", "CRITICAL", "WARNING"))
        .groupBy("category", "risk_level")
        .agg(F.count("*").alias("products"))
        .orderBy(F.col("products").desc(), "category", "risk_level")
    )


def stockout_sellers(risk: DataFrame, k: int = 15) -> DataFrame:
    level = F.col("risk_level")
    rows = risk.filter(level != "HEALTHY").groupBy("seller_name").agg(
        F.count_if(level == "STOCKOUT").alias("stockout_products"),
        F.count_if(level == "WARNING").alias("warning_products"),
        F.sum("estimated_unfulfillable_orders").alias("total_unfulfillable"),
        _sum0("potential_revenue_loss", "total_revenue_loss"),
    )
    return top_k(rows, "stockout_products", k, "seller_name")


def cross_platform_segments(identity: DataFrame) -> DataFrame:
    return (
        identity.groupBy("cross_platform_segment")
        .agg(
            F.count("*").alias("customers"),
            _avg("total_spend_all_platforms", 0, "avg_spend"),
            F.round(F.avg("platform_count"), 1).alias("avg_platforms"),
        )
        .orderBy(F.col("customers").desc(), "cross_platform_segment")
    )


def marketing_segments(insights: DataFrame) -> DataFrame:
    return (
        insights.groupBy("marketing_action_segment")
        .agg(
            F.count("*").alias("customers"),
            _avg("total_revenue", 0, "avg_revenue"),
            _avg("switch_rate_pct", 1, "avg_switch_rate"),
        )
        .orderBy(F.col("customers").desc(), "marketing_action_segment")
    )


def vip_customers(identity: DataFrame, k: int = 20) -> DataFrame:
    hits = identity.filter(F.col("cross_platform_value") == "HIGH")
    return top_k(hits, "total_spend_all_platforms", k, "customer_id").select(
        "customer_name",
        "loyalty_tier",
        "cross_platform_segment",
        "platform_count",
        F.col("total_orders_all_platforms").alias("total_orders"),
        _whole("total_spend_all_platforms", "total_spend"),
        "highest_spend_platform",
        "most_frequent_platform",
        "rfm_segment",
    )


def campaign_recommendations(insights: DataFrame) -> DataFrame:
    return (
        insights.groupBy("marketing_action_segment", "recommended_campaign_action")
        .agg(F.count("*").alias("target_customers"), _avg("total_revenue", 0, "avg_revenue"))
        .orderBy(F.col("target_customers").desc(), "marketing_action_segment")
    )


# -- one customer ------------------------------------------------------------


def customer_profile(customers: DataFrame, customer_id: int) -> DataFrame:
    return customers.filter(F.col("customer_id") == customer_id).select(
        "customer_id", full_name().alias("name"), "city", "state", "loyalty_tier",
        "loyalty_points", _whole("customer_lifetime_value", "clv"), "total_orders",
        "preferred_category", "preferred_payment_method",
    )


def customer_recent_orders(orders: DataFrame, customer_id: int, k: int = 10) -> DataFrame:
    return (
        orders.filter(F.col("customer_id") == customer_id)
        .orderBy(F.col("order_date").desc(), "order_id")
        .limit(k)
        .select(
            "order_id", "order_date", "product_name", "category", "brand",
            _whole("order_value", "order_value"), "order_status", "delivery_time_days",
            "is_returned",
        )
    )


def customer_loyalty(segments: DataFrame, customers: DataFrame, customer_id: int) -> DataFrame:
    mine = segments.filter(F.col("customer_id") == customer_id)
    return mine.join(customers, "customer_id").select(
        F.col("extracted_value").alias("rfm_segment"), "r_score", "f_score", "m_score",
        "rfm_score", "loyalty_tier", "loyalty_points", _whole("customer_lifetime_value", "clv"),
    )


def customer_platforms(profiles: DataFrame, customer_id: int) -> DataFrame:
    mine = profiles.filter(F.col("customer_id") == customer_id)
    return mine.orderBy(F.col("total_spend_on_platform").desc(), "platform", "channel").select(
        "platform", "channel", "orders_on_platform",
        _whole("total_spend_on_platform", "spend"), _whole("avg_order_value_on_platform", "aov"),
        "first_order_on_platform", "last_order_on_platform",
    )


# -- ad-hoc joins and previews -----------------------------------------------


def customer_order_sample(customers: DataFrame, orders: DataFrame, k: int = 10) -> DataFrame:
    """First k joined rows by order id.

    The k order ids are found on two narrow columns; only those k rows are
    then fetched in full.
    """
    ids = split_join(
        orders.select("order_id", "customer_id"),
        customers.select("customer_id"),
        "customer_id",
        spread="order_id",
        how="left_semi",
        counted=orders,
    )
    first = F.broadcast(ids.orderBy("order_id").limit(k).select("order_id"))
    rows = F.broadcast(orders.join(first, "order_id").orderBy("order_id").limit(k))
    people = customers.withColumnRenamed("city", "customer_city").drop("total_orders")
    return people.join(rows, "customer_id").select(
        "customer_id", "first_name", "last_name", "customer_city", "loyalty_tier", "order_id",
        "order_date", "product_name", "category", "order_value", "payment_type", "order_status",
    )


def busiest_customers(customers: DataFrame, orders: DataFrame, k: int = 10) -> DataFrame:
    """Orders are counted per customer before the join."""
    totals = orders.groupBy("customer_id").agg(
        F.count_distinct("order_id").alias("orders"),
        exact_sum(F.col("order_value")).alias("order_value"),
    )
    known = totals.join(customers.select("customer_id"), "customer_id", "left_semi")
    return top_k(known, "orders", k, "customer_id")


def latest_orders(orders: DataFrame, after_id, k: int = 5) -> DataFrame:
    return (
        orders.filter(F.col("order_id") > after_id)
        .orderBy(F.col("order_id").desc())
        .limit(k)
        .select(
            "order_id", "customer_id", "order_date", "category", "order_value", "payment_type",
            "order_status", "shipping_city", "margin", "profit",
        )
    )


# -- business questions ------------------------------------------------------


def high_risk_seller_revenue(forecast: DataFrame) -> DataFrame:
    return forecast.filter(F.col("risk_forecast").isin("CRITICAL", "HIGH")).select(
        "seller_id", "seller_name", "risk_forecast", "current_revenue", "projected_revenue_90d"
    )


def persona_revenue_at_risk(forecast: DataFrame) -> DataFrame:
    rows = distribution(
        forecast, "persona", "persona", F.round(exact_sum(F.col("revenue_at_risk")), 2).alias(
            "total_revenue_at_risk"
        )
    )
    return rows.orderBy(F.col("total_revenue_at_risk").desc(), "persona")


def predicted_tier_drops(forecast: DataFrame) -> DataFrame:
    drop = downgraded("current_loyalty_tier", "predicted_loyalty_tier", strict=True)
    return forecast.filter(drop).select(
        "customer_id", "customer_name", "current_loyalty_tier", "predicted_loyalty_tier",
        "current_clv", "churn_probability_score",
    )


def _pairs(mapping: DataFrame) -> DataFrame:
    return mapping.select("customer_id", "seller_id").distinct()


def churn_heavy_categories(
    forecast: DataFrame, mapping: DataFrame, sellers: DataFrame
) -> DataFrame:
    """Distinct high-churn customers per seller category."""
    risky = forecast.filter(F.col("churn_prediction_30d").isin("VERY HIGH", "HIGH"))
    served = _pairs(mapping).join(risky.select("customer_id"), "customer_id")
    kinds = sellers.select("seller_id", "seller_category")
    labelled = split_join(served, kinds, "seller_id", spread="customer_id", counted=mapping)
    return (
        labelled.groupBy("seller_category")
        .agg(F.count_distinct("customer_id").alias("high_churn_customers"))
        .orderBy(F.col("high_churn_customers").desc(), "seller_category")
    )


def top_clv_with_sellers(
    forecast: DataFrame, mapping: DataFrame, sellers: DataFrame, k: int = 10
) -> DataFrame:
    """Top customers by CLV, one row per seller they buy from.

    Only k customers take part, broadcast against the mapping.
    """
    best = top_k(forecast, "current_clv", k, "customer_id").select(
        "customer_id", "customer_name", "current_clv", F.col("current_rfm_segment").alias("rfm_segment")
    )
    bought = mapping.join(F.broadcast(best), "customer_id").groupBy(*best.columns, "seller_id").agg(
        F.count("*").alias("orders")
    )
    return bought.join(sellers.select("seller_id", "seller_name"), "seller_id")


def order_value_by_persona_and_tier(
    sold: DataFrame, ai: DataFrame, sellers: DataFrame
) -> DataFrame:
    """Average order value; orders are reduced to (customer, seller) sums first."""
    sums = sold.groupBy("customer_id", "seller_id").agg(
        F.sum(units(F.col("order_value"))).alias("u"), F.count("order_value").alias("n")
    )
    named = sums.join(ai.select("customer_id", "persona"), "customer_id")
    tiers = sellers.select("seller_id", "seller_tier")
    labelled = split_join(named, tiers, "seller_id", spread="customer_id", counted=sold)
    mean = F.sum("u").cast("double") / F.nullif(F.sum("n"), F.lit(0))
    return labelled.groupBy("persona", "seller_tier").agg(
        F.sum("n").alias("orders"), F.round(mean, 2).alias("avg_order_value")
    )


def critical_customers_with_sellers(
    customer_forecast: DataFrame, mapping: DataFrame, seller_forecast: DataFrame
) -> DataFrame:
    critical = customer_forecast.filter(F.col("retention_priority") == "CRITICAL").select(
        "customer_id", "customer_name", "current_clv"
    )
    risk = seller_forecast.select("seller_id", "seller_name", "risk_forecast")
    served = _pairs(mapping).join(critical, "customer_id")
    return split_join(served, risk, "seller_id", spread="customer_id", counted=mapping)
