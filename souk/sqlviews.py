"""A SQL way in: tables and marts as views, parametrised reports as table functions.

``attach`` makes them known to the session of an engine; then

    spark.sql("SELECT * FROM customer_profile(:id)", args={"id": 7})
    spark.sql("SELECT persona, sum(revenue_at_risk) FROM forecast_customer_outlook GROUP BY 1")

run as any other query: a function's body is inlined into the plan, so its
arguments reach the scan as pushed filters. Values come as bound parameters,
never as pasted text. ``souk_as_of`` and ``souk_now`` are session variables
that hold the engine's clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from souk.engine import REFRESH_ORDER, Engine
from souk.sources.schemas import BASE_TABLES

VIEWS = [*(n for n in BASE_TABLES if n != "realtime_events_merged"), *REFRESH_ORDER, "platform_profiles"]  # all but the write-back ledger

# Name, parameters, views that are read, query. A wanted level of ALL keeps every row.
FUNCTIONS = [
    (
        "customer_profile", "wanted BIGINT", ("customers",),
        """SELECT customer_id, concat(first_name, ' ', last_name) AS name, city, state, loyalty_tier, loyalty_points,
                  round(customer_lifetime_value, 0) AS clv, total_orders, preferred_category, preferred_payment_method
           FROM customers WHERE customer_id = wanted""",
    ),
    (
        "customer_recent_orders", "wanted BIGINT, most INT DEFAULT 10", ("orders",),
        """SELECT order_id, order_date, product_name, category, brand, round(order_value, 0) AS order_value,
                  order_status, delivery_time_days, is_returned
           FROM (SELECT *, row_number() OVER (ORDER BY order_date DESC, order_id) AS place FROM orders WHERE customer_id = wanted)
           WHERE place <= most""",
    ),
    (
        "customer_loyalty", "wanted BIGINT", ("rfm_segments", "customers"),
        """SELECT s.extracted_value AS rfm_segment, s.r_score, s.f_score, s.m_score, s.rfm_score, c.loyalty_tier,
                  c.loyalty_points, round(c.customer_lifetime_value, 0) AS clv
           FROM rfm_segments s JOIN customers c ON s.customer_id = c.customer_id WHERE s.customer_id = wanted""",
    ),
    (
        "customer_platforms", "wanted BIGINT", ("platform_profiles",),
        """SELECT platform, channel, orders_on_platform, round(total_spend_on_platform, 0) AS spend,
                  round(avg_order_value_on_platform, 0) AS aov, first_order_on_platform, last_order_on_platform
           FROM platform_profiles WHERE customer_id = wanted""",
    ),
    (
        "customers_at_risk", "wanted STRING DEFAULT 'ALL', most INT DEFAULT 50", ("forecast_customer_outlook",),
        """SELECT customer_id, customer_name, persona, current_loyalty_tier, predicted_loyalty_tier, current_rfm_segment,
                  predicted_rfm_segment, churn_prediction_30d, round(churn_probability_score, 2) AS churn_prob,
                  round(current_clv, 0) AS current_clv, round(projected_clv_90d, 0) AS projected_clv_90d,
                  round(revenue_at_risk, 0) AS revenue_at_risk, retention_priority, recommended_intervention
           FROM (SELECT *, row_number() OVER (ORDER BY revenue_at_risk DESC NULLS FIRST, customer_id) AS place
                 FROM forecast_customer_outlook WHERE wanted = 'ALL' OR retention_priority = wanted)
           WHERE place <= most""",
    ),
    (
        "sellers_at_risk", "wanted STRING DEFAULT 'ALL', most INT DEFAULT 50", ("forecast_seller_outlook",),
        """SELECT seller_id, seller_name, seller_type, seller_category, current_seller_tier, predicted_seller_tier,
                  round(current_revenue, 0) AS current_revenue, round(projected_revenue_90d, 0) AS projected_rev_90d,
                  revenue_growth_trend, risk_forecast, round(operational_health_score, 1) AS ops_health, profit_trajectory,
                  round(sustainability_score, 2) AS sustainability, round(revenue_at_risk, 0) AS revenue_at_risk,
                  investment_recommendation, recommended_action
           FROM (SELECT *, row_number() OVER (ORDER BY revenue_at_risk DESC NULLS FIRST, seller_id) AS place
                 FROM forecast_seller_outlook WHERE wanted = 'ALL' OR risk_forecast = wanted)
           WHERE place <= most""",
    ),
]


def attach(engine: Engine, views: list[str] | None = None) -> list[str]:
    """Views (all, or those named), the functions over them and the clock; returns the function names.

    A mart that is not stored yet is built. Attaching another engine replaces all of them.
    """
    spark, names = engine.spark, VIEWS if views is None else views
    for name in names:
        engine.table(name).createOrReplaceTempView(name)
    for name, value in (("souk_as_of", engine.as_of), ("souk_now", engine.now)):
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} TIMESTAMP_NTZ")
        spark.sql(f"SET VARIABLE {name} = CAST(:value AS TIMESTAMP_NTZ)", args={"value": value})
    made = [f for f in FUNCTIONS if set(f[2]) <= set(names)]
    for name, parameters, _, body in made:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE RETURN {body}")
    return [f[0] for f in made]


def ask(engine: Engine, text: str, views: list[str], **values) -> DataFrame:
    """A user's query over some views and the functions over them; values are bound to its :names."""
    attach(engine, views)
    return engine.spark.sql(text, args=values)
