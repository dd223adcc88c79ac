"""Named SQL parts (base tables and marts) the comparison queries are made of."""

from __future__ import annotations

from checks.sqltext import A, E, N, P, R, SUM, case, cols, high, low, mapped_select, mode
from souk.functions.text import WORD_SCORES
from souk.plans import enrichment, forecast_customer, forecast_seller, gold_customer, gold_seller
from souk.plans import inventory, overlay, platforms, rfm
from souk.sources import testdata
from souk.sources.testdata import AS_OF, NOW

AS_OF_SQL = f"DATE '{AS_OF}'"
NOW_SQL = f"TIMESTAMP '{NOW}'"

PARTS: dict[str, str] = {}

# -- base tables --------------------------------------------------------------

_PLACES = "nation JOIN region ON n_regionkey = r_regionkey"
PARTS["m_customers"] = mapped_select(
    testdata.customers(), f"customer JOIN ({_PLACES}) ON c_nationkey = n_nationkey"
)
PARTS["m_sellers"] = mapped_select(
    testdata.sellers(), f"supplier JOIN ({_PLACES}) ON s_nationkey = n_nationkey"
)
PARTS["m_orders"] = mapped_select(
    testdata.orders(),
    "(SELECT *, o_orderkey * 10007 + coalesce(line, 0) AS order_no FROM orders LEFT JOIN (SELECT *, "
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, "
    "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line FROM lineitem) "
    "ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey)",
)
PARTS["m_marketing"] = mapped_select(testdata.marketing(), "events")
PARTS["m_events"] = mapped_select(
    testdata.order_events("(SELECT count(*) FROM supplier)"),
    "events WHERE event_type = 'purchase'",
)
PARTS["m_mapping"] = (
    "SELECT o.customer_id, o.order_id, o.product_id, o.category, "
    "o.order_id % (SELECT count(*) FROM m_sellers) AS seller_id "
    "FROM m_orders o WHERE o.customer_id IN (SELECT customer_id FROM m_customers)"
)

# -- customer facts -----------------------------------------------------------

_span = "date_diff('day', min(order_date), max(order_date))"
_order_facts = {
    "total_orders": "count(*)",
    "unique_orders": "count(DISTINCT order_id)",
    "total_order_value": E("order_value"),
    "total_discount_amount": E("discount_amount"),
    "avg_order_value": A("order_value"),
    "max_order_value": "max(order_value)",
    "min_order_value": "min(order_value)",
    "first_order_date": "min(order_date)",
    "last_order_date": "max(order_date)",
    "order_span_days": _span,
    "total_items_purchased": SUM("quantity"),
    "avg_items_per_order": "avg(quantity)",
    "unique_categories_purchased": "count(DISTINCT category)",
    "unique_brands_purchased": "count(DISTINCT brand)",
    "total_returns": N("is_returned"),
    "total_cancellations": N("is_cancelled"),
    "total_refund_amount": E("refund_amount"),
    "return_rate_pct": P(N("is_returned"), "count(*)"),
    "cancellation_rate_pct": P(N("is_cancelled"), "count(*)"),
    "cod_orders": N("lower(payment_type) = 'cod'"),
    "upi_orders": N("lower(payment_type) = 'upi'"),
    "card_orders": N("lower(payment_type) = 'card'"),
    "wallet_orders": N("lower(payment_type) = 'wallet'"),
    "cod_pct": P(N("cod_flag"), "count(*)"),
    "delivered_orders": N("lower(order_status) = 'delivered'"),
    "avg_delivery_days": "avg(delivery_time_days)",
    "avg_customer_rating": "avg(customer_rating)",
    "high_rto_risk_orders": N("high_rto_risk_flag"),
    "fraud_flagged_orders": N("fraud_flag"),
    "total_margin": E("margin"),
    "total_profit": E("profit"),
}
_order_modes = {
    "most_frequent_category": "category",
    "most_frequent_brand": "brand",
    "preferred_payment_type": "payment_type",
    "preferred_order_source": "order_source",
}
PARTS["m_of_base"] = f"SELECT customer_id, {cols(_order_facts)} FROM m_orders GROUP BY customer_id"
for _out, _col in _order_modes.items():
    PARTS[f"m_ofmode_{_col}"] = mode("m_orders", "customer_id", _col, _out)
PARTS["m_order_facts"] = "SELECT * FROM m_of_base " + " ".join(
    f"LEFT JOIN m_ofmode_{c} USING (customer_id)" for c in _order_modes.values()
)

_marketing_facts = {
    "total_marketing_interactions": "count(*)",
    "unique_campaigns_received": "count(DISTINCT campaign_id)",
    "email_interactions": N("channel = 'email'"),
    "whatsapp_interactions": N("channel = 'whatsapp'"),
    "sms_interactions": N("channel = 'sms'"),
    "push_interactions": N("channel = 'push_notification'"),
    "messages_delivered": N("delivery_status = 'delivered'"),
    "messages_opened": N("open_flag"),
    "messages_clicked": N("click_flag"),
    "messages_converted": N("conversion_flag"),
    "open_rate_pct": P(N("open_flag"), N("delivery_status = 'delivered'")),
    "click_rate_pct": P(N("click_flag"), N("open_flag")),
    "conversion_rate_pct": P(N("conversion_flag"), N("click_flag")),
    "total_marketing_conversion_value": E("conversion_value"),
    "avg_time_to_open_seconds": "avg(time_to_open_seconds)",
    "avg_time_to_click_seconds": "avg(time_to_click_seconds)",
    "avg_engagement_score": A("engagement_score"),
    "avg_propensity_score": A("propensity_to_buy_score"),
    "unsubscribe_count": N("unsubscribe_flag"),
    "spam_flag_count": N("spam_flag"),
    "avg_fatigue_score": A("fatigue_score"),
    "avg_freq_last_7_days": "avg(frequency_last_7_days)",
    "avg_freq_last_30_days": "avg(frequency_last_30_days)",
    "total_marketing_cost": E("marketing_cost"),
    "total_marketing_revenue": E("revenue_generated"),
    "marketing_roi": R(f"({E('revenue_generated')} / nullif({E('marketing_cost')}, 0))", 2),
    "latest_customer_segment": "max(customer_segment)",
    "latest_risk_segment": "max(customer_risk_segment)",
}
_marketing_modes = {
    "best_send_time_hour": "best_send_time_hour",
    "preferred_channel": "channel",
    "preferred_device_marketing": "device_type",
}
PARTS["m_mf_base"] = (
    f"SELECT customer_id, {cols(_marketing_facts)} FROM m_marketing GROUP BY customer_id"
)
for _out, _col in _marketing_modes.items():
    PARTS[f"m_mfmode_{_col}"] = mode("m_marketing", "customer_id", _col, _out)
PARTS["m_marketing_facts"] = "SELECT * FROM m_mf_base " + " ".join(
    f"LEFT JOIN m_mfmode_{c} USING (customer_id)" for c in _marketing_modes.values()
)

# -- customer 360 -------------------------------------------------------------


def _gold_columns() -> str:
    profile = [
        f"c.{n} AS {gold_customer.RENAMED.get(n, n)}" for n in testdata.customers().columns
    ]
    facts = []
    for alias, names in (("o", gold_customer.ORDER_FACTS), ("k", gold_customer.MARKETING_FACTS)):
        for n in names:
            bare = n.rstrip("*")
            facts.append(f"coalesce({alias}.{bare}, 0) AS {bare}" if n != bare else f"{alias}.{bare}")
    return ", ".join(profile + facts)


PARTS["m_gold_base"] = (
    f"SELECT {_gold_columns()} FROM m_customers c LEFT JOIN m_order_facts o USING (customer_id) "
    "LEFT JOIN m_marketing_facts k USING (customer_id)"
)
PARTS["m_gold_customer"] = (
    "SELECT *, total_order_value + total_marketing_conversion_value AS combined_revenue, "
    "total_orders > 0 AS has_ordered, total_marketing_interactions > 0 AS "
    f"has_marketing_engagement, {NOW_SQL} AS created_at FROM m_gold_base"
)


def _reasons(drivers) -> str:
    parts = ", ".join(f"CASE WHEN {c} > {cut} THEN '{name}' END" for name, c, cut in drivers)
    return f"coalesce(nullif(concat_ws(',', {parts}), ''), 'NONE')"


_settle = (
    "1 - (coalesce(cod_pct, 0e0) / 100 * 0.4e0 + coalesce(return_rate_pct, 0e0) / 100 * 0.4e0 "
    "+ total_cancellations * 0.02e0)"
)
_labels = {n: case(*v) for n, v in enrichment.CUSTOMER_LABELS.items()}
_labels["fraud_reason"] = _reasons(enrichment.FRAUD_DRIVERS)
_labels["settlement_probability"] = R(f"greatest(0e0, least(1e0, {_settle}))", 3)
_actions = {n: case(*v) for n, v in enrichment.CUSTOMER_ACTIONS.items()}
_actions["personalization_action"] = (
    "CASE WHEN most_frequent_category IS NULL THEN 'GENERIC' "
    "ELSE 'RECOMMEND_' || most_frequent_category END"
)
LABELS, ACTIONS = _labels, _actions
PARTS["m_ai"] = (
    f"SELECT *, {cols(_labels)}, {cols(_actions)}, {NOW_SQL} AS ai_enriched_at "
    "FROM m_gold_customer"
)

# -- RFM ----------------------------------------------------------------------

PARTS["m_rfm_base"] = (
    f"SELECT customer_id, date_diff('day', last_order_date, {AS_OF_SQL}) AS recency_days, "
    "total_orders AS frequency, total_order_value AS monetary_value FROM m_gold_customer"
)
PARTS["m_rfm_scores"] = """SELECT *, r_score + f_score + m_score AS rfm_score FROM (
    SELECT customer_id,
    6 - ntile(5) OVER (ORDER BY recency_days ASC NULLS LAST, customer_id) AS r_score,
    ntile(5) OVER (ORDER BY frequency DESC NULLS FIRST, customer_id) AS f_score,
    ntile(5) OVER (ORDER BY monetary_value DESC NULLS FIRST, customer_id) AS m_score
    FROM m_rfm_base)"""
PARTS["m_rfm"] = (
    "SELECT customer_id, r_score, f_score, m_score, rfm_score, '\"' || label || '\"' AS "
    "rfm_segment, label AS extracted_value FROM (SELECT *, "
    + case([*rfm.RFM_SEGMENT, *rfm.RFM_DEFAULT], rfm.RFM_OTHER)
    + " AS label FROM m_rfm_scores)"
)

# -- customer forecast --------------------------------------------------------

_fc = forecast_customer
PARTS["m_fc_in"] = (
    "SELECT a.*, s.f_score, s.m_score, s.extracted_value AS segment, profile_clv AS clv, "
    "profile_engagement_score AS eng, churn_risk_score AS churn, "
    "discount_sensitivity_score AS disc, avg_order_value AS aov, "
    f"date_diff('day', last_order_date, {AS_OF_SQL}) AS d, "
    "CASE WHEN order_span_days > 0 THEN total_orders * 30e0 / order_span_days ELSE 0e0 END AS mor "
    "FROM m_ai a LEFT JOIN m_rfm s USING (customer_id)"
)
_p_parts = (
    f"churn * 0.4e0 + {low('1e0', '(d / 120e0)')} * 0.3e0 + (1 - eng) * 0.2e0 "
    f"+ (1 - {low('1e0', '(mor / 5e0)')}) * 0.1e0"
)
_up = (
    "(CASE WHEN max_order_value > 0 AND aov > 0 THEN (1 - aov / max_order_value) * 0.4e0 "
    "ELSE 0e0 END) + least(1e0, unique_categories_purchased / 10e0) * 0.3e0 "
    "+ least(1e0, unique_brands_purchased / 10e0) * 0.3e0"
)
PARTS["m_fc_mid"] = (
    f"SELECT *, {low('1e0', f'({_p_parts})')} AS p, {_up} AS upsell, clv * churn AS exposed, "
    "mor * aov * 3 AS quarter FROM m_fc_in"
)
_resp = (
    "coalesce(avg_engagement_score, 0e0) * 0.3e0 + coalesce(open_rate_pct, 0e0) / 100 * 0.2e0 "
    "+ coalesce(click_rate_pct, 0e0) / 100 * 0.2e0 + coalesce(conversion_rate_pct, 0e0) / 100 "
    "* 0.2e0 + (1 - coalesce(avg_fatigue_score, 0e0)) * 0.1e0"
)
_fc_cols = {
    "customer_id": "customer_id",
    "customer_name": "first_name || ' ' || last_name",
    "city": "city",
    "state": "state",
    "persona": "persona",
    "current_loyalty_tier": "loyalty_tier",
    "predicted_loyalty_tier": case(_fc.PREDICTED_TIER, "@loyalty_tier"),
    "current_rfm_segment": "segment",
    "predicted_rfm_segment": case(_fc.PREDICTED_SEGMENT, "@segment"),
    "current_churn_risk": R("churn", 3),
    "churn_prediction_30d": case(_fc.CHURN_30D, "LOW"),
    "churn_probability_score": R("p", 3),
    "current_clv": R("clv", 2),
    "projected_clv_90d": R("(clv + quarter)", 2),
    "clv_growth_pct_90d": R("(CASE WHEN clv > 0 THEN quarter / clv * 100 ELSE 0e0 END)", 2),
    "current_monthly_order_rate": R("mor", 2),
    "predicted_orders_next_30d": R(
        "(mor * CASE WHEN d > 90 THEN 0.3e0 WHEN d > 60 THEN 0.5e0 WHEN d > 30 THEN 0.8e0 "
        "ELSE 1e0 END)",
        2,
    ),
    "upsell_potential_score": R("upsell", 3),
    "revenue_at_risk": R("(clv * p)", 2),
    "retention_priority": case(_fc.RETENTION_PRIORITY, "LOW"),
    "persona_stability": case(_fc.PERSONA_STABILITY, "MONITOR"),
    "marketing_responsiveness_score": R(f"({_resp})", 3),
    "recommended_intervention": case(_fc.INTERVENTION, _fc.INTERVENTION_OTHER),
    "forecast_generated_at": NOW_SQL,
}
PARTS["m_fc"] = f"SELECT {cols(_fc_cols)} FROM m_fc_mid"
PARTS["m_fc2"] = (
    "SELECT * REPLACE ("
    + case(_fc.INTERVENTION_V2, _fc.INTERVENTION_OTHER)
    + " AS recommended_intervention) FROM m_fc"
)

# -- seller 360 ---------------------------------------------------------------

PARTS["m_sold"] = "SELECT o.*, k.seller_id FROM m_orders o JOIN m_mapping k USING (order_id)"
_seller_orders = {
    "total_orders_actual": "count(*)",
    "unique_orders": "count(DISTINCT order_id)",
    "unique_customers": "count(DISTINCT customer_id)",
    "total_order_value": E("order_value"),
    "total_discount_given": E("discount_amount"),
    "avg_order_value": A("order_value"),
    "max_order_value": "max(order_value)",
    "min_order_value": "min(order_value)",
    "first_order_date": "min(order_date)",
    "last_order_date": "max(order_date)",
    "order_span_days": _span,
    "total_items_sold": SUM("quantity"),
    "avg_items_per_order": "avg(quantity)",
    "unique_categories_sold": "count(DISTINCT category)",
    "unique_brands_sold": "count(DISTINCT brand)",
    "unique_products_sold": "count(DISTINCT product_id)",
    "total_returns": N("is_returned"),
    "total_cancellations": N("is_cancelled"),
    "total_refund_amount": E("refund_amount"),
    "actual_return_rate_pct": P(N("is_returned"), "count(*)"),
    "actual_cancel_rate_pct": P(N("is_cancelled"), "count(*)"),
    "cod_orders": N("cod_flag"),
    "upi_orders": N("lower(payment_type) = 'upi'"),
    "card_orders": N("lower(payment_type) = 'card'"),
    "wallet_orders": N("lower(payment_type) = 'wallet'"),
    "cod_pct": P(N("cod_flag"), "count(*)"),
    "delivered_orders": N("lower(order_status) = 'delivered'"),
    "avg_delivery_days_actual": "avg(delivery_time_days)",
    "avg_customer_rating_actual": "avg(customer_rating)",
    "high_rto_risk_orders": N("high_rto_risk_flag"),
    "fraud_flagged_orders": N("fraud_flag"),
    "total_margin": E("margin"),
    "total_profit": E("profit"),
    "avg_margin_pct": R(A("margin"), 2),
    "profit_margin_pct": R(f"({E('profit')} / nullif({E('order_value')}, 0) * 100)", 2),
}
PARTS["m_seller_orders"] = (
    f"SELECT seller_id, {cols(_seller_orders)} FROM m_sold GROUP BY seller_id"
)


def _served(n: str, pairs: str) -> str:
    scores = {
        "avg_customer_clv": "customer_lifetime_value",
        "avg_customer_churn_risk": "churn_risk_score",
        "avg_customer_engagement": "engagement_score",
        "avg_customer_fraud_risk": "fraud_risk_score",
        "avg_discount_sensitivity": "discount_sensitivity_score",
        "avg_price_sensitivity": "price_sensitivity_score",
    }
    spec = {"total_customers_served": "count(DISTINCT customer_id)"}
    spec |= {out: f"({E(c)} / count({c}))" for out, c in scores.items()}
    spec |= {
        f"{t}_customers": N(f"loyalty_tier = '{t}'") for t in ("platinum", "gold", "silver", "bronze")
    }
    spec["high_value_customer_pct_actual"] = P(
        N("loyalty_tier IN ('platinum', 'gold')"), "count(DISTINCT customer_id)"
    )
    return (
        f"SELECT seller_id, {cols(spec)} FROM {pairs} JOIN m_customers USING (customer_id) "
        "GROUP BY seller_id"
    )


PARTS["m_seller_customers"] = _served("n", "m_mapping")
PARTS["m_seller_customers_once"] = _served(
    "n", "(SELECT DISTINCT seller_id, customer_id FROM m_mapping)"
)
for _col, _out in (
    ("category", "most_sold_category"),
    ("brand", "most_sold_brand"),
    ("payment_type", "preferred_payment_type"),
):
    PARTS[f"m_top_{_col}"] = mode("m_sold", "seller_id", _col, _out, nulls=True)
PARTS["m_top_values"] = (
    "SELECT * FROM m_top_category JOIN m_top_brand USING (seller_id) "
    "JOIN m_top_payment_type USING (seller_id)"
)
_seller_profile = ", ".join(
    f"s.{n} AS {gold_seller.RENAMED.get(n, n)}" for n in testdata.sellers().columns
)
_segments = {n: case(*v) for n, v in gold_seller.SEGMENTS.items()}
PARTS["m_gold_seller"] = (
    f"SELECT *, date_diff('day', seller_onboard_date, {AS_OF_SQL}) AS seller_tenure_days, "
    + P("active_products", "total_products_listed")
    + " AS product_active_pct, "
    + P("fraud_flagged_orders", "total_orders_actual")
    + f" AS fraud_rate_pct, {cols(_segments)}, {NOW_SQL} AS created_at FROM "
    f"(SELECT {_seller_profile} FROM m_sellers s) LEFT JOIN m_seller_orders USING (seller_id) "
    "LEFT JOIN m_seller_customers USING (seller_id) LEFT JOIN m_top_values USING (seller_id)"
)

_fact = []
for _alias, _spec in (
    ("o", gold_seller.FACT_ORDER),
    ("c", gold_seller.FACT_CUSTOMER),
    ("s", gold_seller.FACT_SELLER),
):
    for _entry in _spec:
        _old, _, _new = _entry.partition(":")
        _fact.append(f"{_alias}.{_old} AS {_new or _old}")
PARTS["m_fact"] = (
    f"SELECT {', '.join(_fact)}, c.first_name || ' ' || c.last_name AS customer_name "
    "FROM m_orders o JOIN m_customers c ON o.customer_id = c.customer_id "
    "JOIN m_mapping k ON o.order_id = k.order_id JOIN m_sellers s ON k.seller_id = s.seller_id"
)

# -- seller labels and forecast -------------------------------------------------


def _driver(drivers) -> str:
    scored = ", ".join(
        f"{{'s': coalesce({c}, 0e0) / {full}e0, 'name': '{name}'}}" for name, c, full in drivers
    )
    return f"greatest({scored}).name".replace(".0e0", "e0")


_mood = "lower(performance_segment || ' ' || growth_segment)"
_word_values = ", ".join(f"('{word}', {score}e0)" for word, score in WORD_SCORES.items())
PARTS["m_words"] = f"SELECT * FROM (VALUES {_word_values}) AS w(word, score)"
PARTS["m_sentiment"] = (
    "SELECT seller_id, " + R("coalesce(avg(score), 0e0)", 3) + " AS performance_sentiment_score "
    f"FROM (SELECT seller_id, unnest(string_split({_mood}, ' ')) AS word FROM m_gold_seller) "
    "LEFT JOIN m_words USING (word) GROUP BY seller_id"
)
_context = " || ".join(
    f"'{text}' || CAST("
    + (column if column in enrichment.CONTEXT_AS_IS else f"CAST({column} AS DECIMAL(38,2))")
    + " AS VARCHAR)"
    for text, column in enrichment.CONTEXT_PARTS
)
_seller_labels = {n: case(*v) for n, v in enrichment.SELLER_LABELS.items()}
_seller_labels["extracted_risk"] = _driver(enrichment.RISK_DRIVERS)
_seller_labels["extracted_strength"] = _driver(enrichment.STRENGTH_DRIVERS)
_seller_labels["final_action"] = case(enrichment.FINAL_ACTION, enrichment.FINAL_ACTION_OTHER)
PARTS["m_seller_ai"] = (
    f"SELECT *, {_context} AS seller_context, {cols(_seller_labels)}, {NOW_SQL} AS "
    "created_at_seller FROM m_gold_seller LEFT JOIN m_sentiment USING (seller_id)"
)

_fs = forecast_seller
PARTS["m_fs_in"] = (
    "SELECT *, "
    + ", ".join(f"{column} AS {short}" for short, column in _fs.SHORT.items())
    + " FROM m_seller_ai"
)
_esc = (
    "coalesce(rr, 0e0) / 50e0 * 0.25e0 + coalesce(cr, 0e0) / 30e0 * 0.2e0 "
    "+ coalesce(fraud, 0e0) / 10e0 * 0.25e0 + coalesce(risk, 0e0) / 100e0 * 0.2e0 "
    "+ (CASE WHEN g < 0 THEN abs(g) / 20e0 ELSE 0e0 END) * 0.1e0"
)
_health = (
    f"(100e0 - {high('0e0', '(days - 3)')} * 8 - late * 1.5e0 - rr - cr * 1.2e0)"
)
_sustain = (
    "score / 100 * 0.25e0 + gscore / 100 * 0.2e0 + (100 - risk) / 100 * 0.2e0 "
    "+ coalesce(repeat, 0e0) / 100 * 0.15e0 + least(100e0, coalesce(margin, 0e0)) / 100 * 0.1e0 "
    "+ coalesce(roi, 0e0) / greatest(1e0, abs(coalesce(roi, 1e0))) * 0.1e0"
)
PARTS["m_fs_mid"] = (
    f"SELECT *, {low('1e0', f'({_esc})')} AS e, {_health} AS raw_health FROM m_fs_in"
)
_fs_cols = {
    "seller_id": "seller_id",
    "seller_name": "seller_name",
    "seller_type": "seller_type",
    "seller_category": "seller_category",
    "seller_city": "seller_city",
    "years_on_platform": "years_on_platform",
    "current_seller_tier": "seller_tier",
    "predicted_seller_tier": case(_fs.PREDICTED_TIER, "@seller_tier"),
    "current_revenue": R("value", 2),
    "projected_revenue_90d": R(
        "(CASE WHEN monthly > 0 THEN monthly * 3 * (1 + g / 100) "
        "ELSE value * 0.25e0 * (1 + g / 100) END)",
        2,
    ),
    "current_growth_rate": R("g", 2),
    "revenue_growth_trend": case(_fs.GROWTH_TREND, "DECLINING"),
    "current_risk_segment": "risk_segment",
    "risk_escalation_probability": R("e", 3),
    "risk_forecast": case(_fs.RISK_FORECAST, "STABLE"),
    "current_unique_customers": "unique_customers",
    "repeat_customer_pct": R("repeat", 2),
    "customer_base_trend": case(_fs.CUSTOMER_BASE, "DECLINING"),
    "current_avg_delivery_days": R("days", 1),
    "current_late_delivery_pct": R("late", 2),
    "operational_health_score": R(high("0e0", low("100e0", "raw_health")), 2),
    "operational_health_forecast": case(_fs.OPS_FORECAST, "HEALTHY"),
    "current_profit_margin_pct": R("margin", 2),
    "profit_trajectory": case(_fs.PROFIT_TRAJECTORY, "LOSS MAKING"),
    "current_performance": "performance",
    "predicted_performance": case(_fs.PREDICTED_PERFORMANCE, "@performance"),
    "sustainability_score": R(f"({_sustain})", 3),
    "revenue_at_risk": R("(value * e)", 2),
    "investment_recommendation": case(_fs.INVESTMENT, "MONITOR"),
    "recommended_action": case(_fs.RECOMMENDED_ACTION, "STANDARD_MONITORING"),
    "forecast_generated_at": NOW_SQL,
}
PARTS["m_fs"] = f"SELECT {cols(_fs_cols)} FROM m_fs_mid"

# -- live overlay ---------------------------------------------------------------

_activity = {
    "recent_order_count": "count(*)",
    "recent_order_value": R(E("order_value"), 2),
    "recent_avg_order_value": R(A("order_value"), 2),
    "last_event_time": "max(event_timestamp)",
    "recent_returns": N("is_returned"),
    "recent_cancellations": N("is_cancelled"),
    "recent_avg_rating": R("avg(customer_rating)", 2),
    "recent_avg_delivery_days": R("avg(delivery_time_days)", 1),
    "recent_return_rate": P(N("is_returned"), "count(*)"),
}
PARTS["m_cact"] = f"SELECT customer_id, {cols(_activity)} FROM m_events GROUP BY customer_id"
PARTS["m_sact"] = (
    f"SELECT seller_id, {cols(_activity)}, count(DISTINCT customer_id) AS recent_unique_customers "
    "FROM m_events GROUP BY seller_id"
)
_drop6 = f"(CASE WHEN last_event_time >= {NOW_SQL} - INTERVAL 6 HOUR THEN 0.1e0 ELSE 0e0 END)"
_drop1 = f"(CASE WHEN last_event_time >= {NOW_SQL} - INTERVAL 1 HOUR THEN 0.05e0 ELSE 0e0 END)"
PARTS["m_cl_in"] = (
    "SELECT f.*, a.last_event_time, coalesce(recent_order_count, 0) AS n, "
    "coalesce(recent_order_value, 0e0) AS v, "
    "churn_probability_score - coalesce(recent_order_count, 0) * 0.03e0 AS t0, "
    f"{_drop6} AS d6, {_drop1} AS d1 FROM m_fc f LEFT JOIN m_cact a USING (customer_id)"
)
PARTS["m_cl_mid"] = (
    f"SELECT *, {high('0e0', 't0')} AS s0, {high('0e0', '(t0 - d6)')} AS s6, "
    f"{high('0e0', '(t0 - d6 - d1)')} AS s1, current_clv + v AS live_clv, "
    f"(current_clv + v) * {high('0e0', 't0')} AS live_exposed FROM m_cl_in"
)
_cl_cols = {
    **{
        n: n
        for n in "customer_id customer_name city state persona current_loyalty_tier "
        "predicted_loyalty_tier current_rfm_segment predicted_rfm_segment current_churn_risk".split()
    },
    "baseline_churn_prediction": "churn_prediction_30d",
    "baseline_churn_score": "churn_probability_score",
    "realtime_order_count": "n",
    "realtime_order_value": "v",
    "last_realtime_event": "last_event_time",
    "realtime_churn_score": R("s1", 3),
    "realtime_churn_prediction": case(overlay.REALTIME_CHURN, "LOW"),
    "realtime_clv": R("live_clv", 2),
    "baseline_clv": "current_clv",
    "realtime_projected_clv_90d": R("(projected_clv_90d + v * 3)", 2),
    "baseline_projected_clv_90d": "projected_clv_90d",
    "realtime_revenue_at_risk": R("(live_clv * s6)", 2),
    "baseline_revenue_at_risk": "revenue_at_risk",
    "realtime_retention_priority": case(overlay.REALTIME_PRIORITY, "LOW"),
    "baseline_retention_priority": "retention_priority",
    "prediction_changed": "coalesce(churn_prediction_30d != "
    + case(overlay.CHURN_FOR_CHANGE, "LOW")
    + ", FALSE)",
    "upsell_potential_score": "upsell_potential_score",
    "persona_stability": "persona_stability",
    "marketing_responsiveness_score": "marketing_responsiveness_score",
    "recommended_intervention": "recommended_intervention",
    "last_refreshed_at": NOW_SQL,
}
PARTS["m_cl"] = f"SELECT {cols(_cl_cols)} FROM m_cl_mid"

_rated = "(CASE WHEN coalesce(recent_avg_rating, 0e0) >= 4 THEN 0.05e0 ELSE 0e0 END)"
_busy = "(CASE WHEN coalesce(recent_order_count, 0) >= 5 THEN 0.03e0 ELSE 0e0 END)"
PARTS["m_sl_in"] = (
    "SELECT f.*, a.*, coalesce(recent_order_value, 0e0) AS v, "
    "risk_escalation_probability + coalesce(recent_return_rate, 0e0) / 100 * 0.3e0 AS raw, "
    f"{_rated} AS good, {_busy} AS busy FROM m_fs f LEFT JOIN (SELECT seller_id AS sid, * EXCLUDE "
    "(seller_id) FROM m_sact) a ON f.seller_id = a.sid"
)
PARTS["m_sl_mid"] = (
    f"SELECT *, {high('0e0', 'raw')} AS x, {high('0e0', '(raw - good)')} AS x4, "
    "current_revenue + v AS live, operational_health_score - coalesce(recent_return_rate, 0e0) "
    "* 0.5e0 + (CASE WHEN coalesce(recent_avg_delivery_days, 99e0) <= 3 THEN 5e0 ELSE 0e0 END) "
    "+ (CASE WHEN coalesce(recent_avg_rating, 0e0) >= 4 THEN 3e0 ELSE 0e0 END) AS raw_ops "
    "FROM m_sl_in"
)
_risk_now = case(overlay.REALTIME_RISK, "STABLE")
_sl_cols = {
    **{
        n: n
        for n in "seller_id seller_name seller_type seller_category seller_city "
        "years_on_platform current_seller_tier predicted_seller_tier".split()
    },
    "baseline_revenue": "current_revenue",
    "realtime_revenue": R("live", 2),
    "realtime_order_count": "coalesce(recent_order_count, 0)",
    "realtime_order_value": "v",
    "realtime_new_customers": "coalesce(recent_unique_customers, 0)",
    "last_realtime_event": "last_event_time",
    "realtime_revenue_lift_pct": R(
        "(CASE WHEN current_revenue > 0 THEN v / current_revenue * 100 ELSE 0e0 END)", 2
    ),
    "baseline_projected_rev_90d": "projected_revenue_90d",
    "realtime_projected_rev_90d": R("(projected_revenue_90d + v * 12)", 2),
    "revenue_growth_trend": "revenue_growth_trend",
    "current_risk_segment": "current_risk_segment",
    "baseline_risk_forecast": "risk_forecast",
    "baseline_risk_prob": "risk_escalation_probability",
    "realtime_risk_score": R(high("0e0", "(raw - good - busy)"), 3),
    "realtime_risk_forecast": _risk_now,
    "baseline_ops_health": "operational_health_score",
    "realtime_ops_health": R(high("0e0", low("100e0", "raw_ops")), 2),
    "baseline_sustainability": "sustainability_score",
    "baseline_revenue_at_risk": "revenue_at_risk",
    "realtime_revenue_at_risk": R("(live * x4)", 2),
    "profit_trajectory": "profit_trajectory",
    "customer_base_trend": "customer_base_trend",
    "investment_recommendation": "investment_recommendation",
    "recommended_action": "recommended_action",
    "prediction_changed": f"coalesce(risk_forecast != {_risk_now}, FALSE)",
    "last_refreshed_at": NOW_SQL,
}
PARTS["m_sl"] = f"SELECT {cols(_sl_cols)} FROM m_sl_mid"

# -- inventory and platforms ------------------------------------------------------

PARTS["m_inv_last"] = (
    "SELECT seller_id, product_id, product_name, category, stock_level_at_order FROM (SELECT *, "
    "row_number() OVER (PARTITION BY seller_id, product_id ORDER BY order_date DESC, "
    "order_id DESC) AS place FROM m_sold WHERE product_id IS NOT NULL) WHERE place = 1"
)
PARTS["m_inv_agg"] = (
    "SELECT seller_id, product_id, "
    + N("order_status = 'shipped' OR payment_status = 'pending'")
    + f" AS pending_orders, {A('order_value')} AS avg_value FROM m_sold "
    "WHERE product_id IS NOT NULL GROUP BY ALL"
)
PARTS["m_inv_mid"] = (
    "SELECT seller_id, product_id, seller_name, product_name, category, stock_level_at_order AS "
    "current_stock_level, pending_orders, stock_level_at_order - pending_orders AS "
    "stock_after_pending, greatest(0, pending_orders - stock_level_at_order) AS "
    "estimated_unfulfillable_orders, avg_value FROM m_inv_last JOIN m_inv_agg USING (seller_id, "
    "product_id) JOIN m_sellers USING (seller_id)"
)
PARTS["m_inv"] = (
    "SELECT * EXCLUDE (avg_value), "
    + case(inventory.RISK_LEVEL, "HEALTHY")
    + " AS risk_level, "
    + R("(estimated_unfulfillable_orders * avg_value)", 2)
    + " AS potential_revenue_loss FROM m_inv_mid"
)
PARTS["m_stock_alerts"] = (
    "SELECT seller_id, product_id, seller_name, product_name, category, current_stock_level AS "
    "current_stock, pending_orders, risk_level, estimated_unfulfillable_orders AS "
    f"estimated_stockout_orders, potential_revenue_loss, {NOW_SQL} AS alert_timestamp, 'OPEN' AS "
    "alert_status FROM m_inv WHERE risk_level IN ('STOCKOUT', 'CRITICAL')"
)
PARTS["m_platforms"] = (
    "SELECT customer_id, order_source AS platform, traffic_source AS channel, count(*) AS "
    f"orders_on_platform, {E('order_value')} AS total_spend_on_platform, "
    + R(f"({E('order_value')} / count(*))", 2)
    + " AS avg_order_value_on_platform, min(order_date) AS first_order_on_platform, "
    "max(order_date) AS last_order_on_platform, count(DISTINCT category) AS categories_bought "
    "FROM m_orders GROUP BY ALL"
)
PARTS["m_plat"] = (
    f"SELECT customer_id, order_source AS platform, count(*) AS n, {E('order_value')} AS spend "
    "FROM m_orders GROUP BY ALL"
)
PARTS["m_ident_base"] = (
    "SELECT customer_id, count(*) AS platform_count, string_agg(platform, ',' ORDER BY platform) "
    f"AS all_platforms, {SUM('n')} AS total_orders_all_platforms, {E('spend')} AS "
    "total_spend_all_platforms FROM m_plat GROUP BY customer_id"
)
PARTS["m_best_spend"] = (
    "SELECT customer_id, platform AS highest_spend_platform FROM (SELECT *, row_number() OVER "
    "(PARTITION BY customer_id ORDER BY spend DESC, platform) AS place FROM m_plat) WHERE place = 1"
)
PARTS["m_best_count"] = (
    "SELECT customer_id, platform AS most_frequent_platform FROM (SELECT *, row_number() OVER "
    "(PARTITION BY customer_id ORDER BY n DESC, platform) AS place FROM m_plat) WHERE place = 1"
)
PARTS["m_identity"] = (
    "SELECT b.*, highest_spend_platform, most_frequent_platform, first_name || ' ' || last_name "
    "AS customer_name, loyalty_tier, extracted_value AS rfm_segment, "
    + case(platforms.SEGMENT, "SINGLE_PLATFORM")
    + " AS cross_platform_segment, "
    + case(platforms.VALUE_LEVEL, "LOW")
    + " AS cross_platform_value FROM m_ident_base b JOIN m_best_spend USING (customer_id) "
    "JOIN m_best_count USING (customer_id) JOIN m_customers USING (customer_id) "
    "LEFT JOIN m_rfm USING (customer_id)"
)
PARTS["m_switch"] = (
    "SELECT customer_id, coalesce("
    + P(N("order_source != before"), "count(before)")
    + ", 0e0) AS switch_rate_pct FROM (SELECT customer_id, order_source, lag(order_source) OVER "
    "(PARTITION BY customer_id ORDER BY order_date, order_time, order_id) AS before FROM m_orders) "
    "GROUP BY customer_id"
)
PARTS["m_cross_base"] = (
    "SELECT customer_id, platform_count, total_spend_all_platforms AS total_revenue, "
    "switch_rate_pct FROM m_identity JOIN m_switch USING (customer_id)"
)
PARTS["m_cross_seg"] = (
    "SELECT *, "
    + case(platforms.MARKETING_SEGMENT, "OCCASIONAL")
    + " AS marketing_action_segment FROM m_cross_base"
)
PARTS["m_cross"] = (
    "SELECT *, "
    + case(platforms.CAMPAIGN_ACTION, "AWARENESS_NEWSLETTER")
    + " AS recommended_campaign_action FROM m_cross_seg"
)
