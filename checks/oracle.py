"""Comparison SQL per registered query."""

from __future__ import annotations

from checks.parts import AS_OF_SQL, LABELS, NOW_SQL, PARTS, _seller_labels
from checks.sqltext import _NAME, A, E, N, P, R, SUM, case, compose, day, moment, texted
from souk.plans import alerts, enrichment, merge
from souk.registry import NAMED_SELLERS, ONE_CUSTOMER
from souk.sources import testdata

O: dict[str, str] = {}


def h(key: str, salt: str = "") -> str:
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '{salt}'), 1, 8)) AS BIGINT)"


def top(source: str, select: str, order: str, k: int, where: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    return f"SELECT {select} FROM (SELECT * FROM {source}{w} ORDER BY {order} LIMIT {k})"


# -- sources ---------------------------------------------------------------------

CUSTOMER_DAYS = ["date_of_birth", "signup_date", "last_login_date", "last_order_date"]
O["src01_customers"] = texted("m_customers", CUSTOMER_DAYS)
O["src01_orders"] = texted("m_orders", ["order_date"])
O["src01_marketing_interactions"] = texted("m_marketing", moments=["send_timestamp"])
O["src01_sellers"] = texted("m_sellers", ["seller_onboard_date"])
O["src01_realtime_order_events"] = texted("m_events", moments=["event_timestamp"])
O["src02_seller_json_ingest"] = O["src01_sellers"]
O["src02_json_paths"] = (
    "SELECT seller_id, seller_name, seller_tier, active_products, count(*) AS items FROM m_sellers GROUP BY ALL "
    "UNION ALL SELECT NULL, NULL, NULL, NULL, 2 * count(*) FROM m_sellers"
)
O["src03_replace_table"] = "SELECT loyalty_tier, count(*) AS customers FROM m_customers GROUP BY 1"
O["src04_append_rows"] = O["src01_realtime_order_events"]
O["src05_create_if_absent"] = "SELECT event_id FROM m_events"
O["src06_batch_snapshot"] = "SELECT count(*) AS events FROM m_events"
O["src07_change_stream"] = O["src01_realtime_order_events"]
O["src08_column_defaults"] = (
    f"SELECT * REPLACE ({moment('event_timestamp')} AS event_timestamp), "
    f"{moment(NOW_SQL)} AS landed_at FROM m_events"
)
O["src09_result_frame"] = (
    "SELECT count(*) AS rows, count(DISTINCT city) AS cities FROM m_gold_customer"
)
O["src10_add_and_fill_column"] = "SELECT customer_id, rfm_segment, extracted_value FROM m_rfm"

# -- projections, filters ------------------------------------------------------------

O["prj01_rename"] = (
    "SELECT customer_id, city AS customer_city, total_orders AS profile_total_orders, "
    "customer_lifetime_value AS profile_clv FROM m_customers"
)
O["prj02_star_plus_columns"] = (
    f"SELECT * REPLACE ({day('seller_onboard_date')} AS seller_onboard_date), "
    + P("active_products", "total_products_listed")
    + " AS product_active_pct FROM m_sellers"
)
O["prj03_lateral_alias"] = (
    "SELECT customer_id, "
    + R("(total_orders * 30e0 / nullif(order_span_days, 0) * avg_order_value * 3)", 2)
    + " AS quarter_value FROM m_gold_customer"
)
O["prj04_rule_ladder"] = (
    f"SELECT customer_id, {case(*enrichment.CUSTOMER_ACTIONS['payment_action'])} AS payment_action "
    "FROM m_gold_customer"
)
_brand = " ".join(f"WHEN {k} THEN '{v}'" for k, v in merge.BRANDS.items())
BRAND_SQL = f"CASE {h('event_id', 'brand')} % 5 {_brand} ELSE '{merge.BRAND_OTHER}' END"
O["prj05_simple_case"] = f"SELECT event_id, {BRAND_SQL} AS brand FROM m_events"
O["prj06_inline_conditional"] = (
    "SELECT order_id, CASE WHEN customer_rating >= 4 THEN 'liked' ELSE 'other' END AS opinion "
    "FROM m_orders"
)
O["prj07_distinct"] = "SELECT DISTINCT extracted_value FROM m_rfm"
O["prj08_scalar_subqueries"] = (
    f"SELECT count(*) AS total_events, {moment('max(event_timestamp)')} AS last_event, "
    "(SELECT count(*) FROM m_orders) AS total_orders FROM m_events"
)
O["flt01_compare_and_or"] = (
    "SELECT seller_id, product_id, risk_level, stock_after_pending, pending_orders FROM m_inv "
    "WHERE (risk_level = 'WARNING' AND stock_after_pending < 5) OR pending_orders > 2"
)
O["flt02_in_list"] = (
    "SELECT customer_id, churn_prediction_30d FROM m_fc "
    "WHERE churn_prediction_30d IN ('VERY HIGH', 'HIGH')"
)
O["flt03_not_in_subquery"] = (
    "SELECT customer_id FROM m_customers WHERE customer_id NOT IN (SELECT customer_id FROM m_events)"
)
O["flt04_null_tests"] = (
    "SELECT order_id, coupon_code FROM m_orders WHERE coupon_code IS NOT NULL "
    "AND customer_rating IS NULL"
)
O["flt05_current_vs_predicted"] = (
    "SELECT seller_id, current_seller_tier, predicted_seller_tier FROM m_fs "
    "WHERE current_seller_tier <> predicted_seller_tier"
)
O["flt06_chosen_filter"] = (
    "SELECT customer_id, retention_priority FROM m_fc WHERE retention_priority = 'CRITICAL'"
)
O["flt07_point_lookup"] = (
    f"SELECT order_id, customer_id, order_value FROM m_orders WHERE customer_id = {ONE_CUSTOMER}"
)
O["flt08_boolean_predicate"] = "SELECT order_id, customer_id FROM m_orders WHERE fraud_flag"

# -- joins -----------------------------------------------------------------------------

O["jn01_inner"] = (
    "SELECT o.customer_id, o.order_id, o.order_value, c.loyalty_tier FROM m_orders o "
    "JOIN m_customers c ON o.customer_id = c.customer_id"
)
O["jn03_left_two_facts"] = (
    "SELECT c.customer_id, o.total_orders, k.total_marketing_interactions FROM m_customers c "
    "LEFT JOIN m_order_facts o ON o.customer_id = c.customer_id "
    "LEFT JOIN m_marketing_facts k ON k.customer_id = c.customer_id"
)
O["jn05_left_activity"] = (
    "SELECT customer_id, churn_probability_score, recent_order_count FROM m_fc "
    "LEFT JOIN m_cact USING (customer_id)"
)
O["jn06_sample_with_one_seller"] = (
    "SELECT customer_id, preferred_category, preferred_payment_method, (SELECT seller_id FROM "
    f"m_sellers ORDER BY {h('seller_id', 's')}, seller_id LIMIT 1) AS seller_id FROM m_customers "
    f"ORDER BY {h('customer_id', 'c')}, customer_id LIMIT 10"
)


def _options(values: list[str], salt: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {h('event_id', salt)} % {len(values)} {arms} END"


_qty = f"greatest(1, {h('event_id', 'qty')} % 5)"
_prod = f"CAST({h('event_id')} % 500 + 1 AS VARCHAR)"
_merged = {
    "order_id": "(SELECT coalesce(max(order_id), 0) FROM m_orders) + row_number() OVER "
    "(ORDER BY event_timestamp, event_id)",
    "customer_id": "e.customer_id",
    "order_date": "CAST(event_timestamp AS DATE)",
    "order_time": "strftime(event_timestamp, '%H:%M:%S')",
    "product_id": f"'P' || {_prod}",
    "product_name": f"'Product_' || {_prod}",
    "brand": BRAND_SQL,
    "category": "e.category",
    "sub_category": "e.category || '_sub'",
    "quantity": _qty,
    "unit_price": R(f"(order_value / {_qty})", 2),
    "order_value": "order_value",
    "discount_amount": R(f"(order_value * ({h('event_id', 'disc')} % 20) / 100)", 2),
    "coupon_code": f"CASE WHEN {h('event_id', 'coupon')} % 3 = 0 THEN 'COUP' || "
    f"CAST({h('event_id')} % 100 AS VARCHAR) END",
    "payment_type": "payment_type",
    "payment_status": "CASE WHEN is_cancelled THEN 'Refunded' ELSE 'Completed' END",
    "order_status": "CASE WHEN is_cancelled THEN 'Cancelled' WHEN is_returned THEN 'Returned' "
    "ELSE 'Delivered' END",
    "delivery_partner": _options(merge.PARTNERS, "dp"),
    "warehouse_id": f"'WH' || CAST({h('event_id', 'wh')} % 10 + 1 AS VARCHAR)",
    "shipping_city": "city",
    "shipping_state": "state",
    "shipping_pincode": "pincode",
    "delivery_time_days": "delivery_time_days",
    "is_returned": "is_returned",
    "return_reason": f"CASE WHEN is_returned THEN {_options(merge.RETURN_REASONS, 'rr')} END",
    "refund_amount": f"CASE WHEN is_returned THEN {R('(order_value * 0.9e0)', 2)} ELSE 0e0 END",
    "is_cancelled": "is_cancelled",
    "cancellation_reason": f"CASE WHEN is_cancelled THEN {_options(merge.CANCEL_REASONS, 'cr')} END",
    "cod_flag": "payment_type = 'COD'",
    "customer_rating": "customer_rating",
    "inventory_available_flag": "TRUE",
    "stock_level_at_order": f"{h('event_id', 'stk')} % 500 + 10",
    "high_rto_risk_flag": "is_returned AND delivery_time_days > 5",
    "fraud_flag": "order_value > 15000 AND payment_type = 'COD'",
    "order_source": _options(merge.ORDER_SOURCES, "src"),
    "traffic_source": _options(merge.TRAFFIC_SOURCES, "trf"),
    "campaign_id": f"CASE WHEN {h('event_id', 'cmp')} % 3 = 0 THEN 'CMP' || "
    f"CAST({h('event_id')} % 50 AS VARCHAR) END",
    "margin": R(f"(order_value * (15 + {h('event_id', 'mgn')} % 20) / 100)", 2),
    "profit": R(f"(order_value * (5 + {h('event_id', 'pft')} % 15) / 100)", 2),
    "event_id": "event_id",
    "seller_id": "seller_id",
}
PARTS["m_merged"] = (
    "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _merged.items())
    + " FROM m_events e JOIN m_customers c ON e.customer_id = c.customer_id"
)
O["jn07_composite_key_mapping"] = (
    "SELECT o.customer_id, o.order_id, o.product_id, o.category, e.seller_id FROM m_merged o "
    "JOIN m_events e ON o.customer_id = e.customer_id AND o.order_date = "
    "CAST(e.event_timestamp AS DATE) AND o.order_value = e.order_value"
)
_nth = "row_number() OVER (PARTITION BY customer_id, {0}, order_value ORDER BY {1}) AS nth"
_day_of_event = "CAST(event_timestamp AS DATE)"
O["jn07_one_to_one_mapping"] = (
    "SELECT o.customer_id, o.order_id, o.product_id, o.category, e.seller_id FROM "
    f"(SELECT *, {_nth.format('order_date', 'order_id')} FROM m_merged) o JOIN "
    f"(SELECT *, {_nth.format(_day_of_event, 'event_timestamp, event_id')} FROM m_events) e ON "
    "o.customer_id = e.customer_id AND o.order_date = CAST(e.event_timestamp AS DATE) AND "
    "o.order_value = e.order_value AND o.nth = e.nth"
)
O["jn08_left_anti"] = "SELECT event_id, customer_id FROM m_events WHERE NOT is_cancelled"
O["jn09_flatten_array"] = "SELECT customer_id, platform FROM m_plat"
LOYALTY = (
    "SELECT extracted_value AS rfm_segment, r_score, f_score, m_score, rfm_score, loyalty_tier, "
    f"loyalty_points, {R('customer_lifetime_value', 0)} AS clv FROM m_rfm JOIN m_customers "
    f"USING (customer_id) WHERE customer_id = {ONE_CUSTOMER}"
)
O["jn10_lookup_join"] = LOYALTY

# -- aggregates ----------------------------------------------------------------------------

O["agg01_by_key"] = (
    f"SELECT brand, count(*) AS orders, {E('order_value')} AS total, {A('order_value')} AS mean, "
    "min(order_value) AS lowest, max(order_value) AS highest FROM m_orders GROUP BY brand"
)
O["agg02_many_distinct"] = (
    "SELECT seller_id, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers, "
    "count(DISTINCT product_id) AS products, count(DISTINCT brand) AS brands, "
    "count(DISTINCT category) AS categories FROM m_sold GROUP BY seller_id"
)
O["agg03_conditional_counts"] = (
    f"SELECT category, {N('is_returned')} AS returned, {N('is_cancelled')} AS cancelled, "
    + N("payment_type = 'COD'")
    + " AS cod FROM m_orders GROUP BY category"
)
O["agg04_safe_percentage"] = (
    "SELECT brand, category, "
    + P(N("fraud_flag"), N("payment_type = 'COD'"))
    + " AS fraud_per_cod FROM m_orders GROUP BY ALL"
)
O["agg05_mode"] = (
    "SELECT customer_id, most_frequent_category AS favourite_category, most_frequent_brand AS "
    "favourite_brand FROM m_ofmode_category FULL JOIN m_ofmode_brand USING (customer_id)"
)
O["agg06_largest_text"] = (
    "SELECT customer_id, max(customer_segment) AS latest_segment FROM m_marketing GROUP BY 1"
)
O["agg07_date_span"] = (
    "SELECT customer_id, date_diff('day', min(order_date), max(order_date)) AS span_days "
    "FROM m_orders GROUP BY 1"
)
O["agg08_ratio_of_sums"] = (
    "SELECT channel, "
    + R(f"({E('revenue_generated')} / nullif({E('marketing_cost')}, 0))", 2)
    + " AS roi FROM m_marketing GROUP BY 1"
)
O["agg09_global"] = (
    f"SELECT count(*) AS orders, {E('order_value')} AS total, {day('min(order_date)')} AS first, "
    f"{day('max(order_date)')} AS last FROM m_orders"
)
O["agg10_two_keys"] = (
    f"SELECT category, order_status, count(*) AS orders, {E('order_value')} AS total "
    "FROM m_orders GROUP BY ALL"
)
O["agg11_by_alias"] = (
    "SELECT current_loyalty_tier || '>' || predicted_loyalty_tier AS move, count(*) AS customers "
    "FROM m_fc GROUP BY move"
)
O["agg12_having"] = (
    "SELECT seller_id, count(*) AS products FROM m_inv WHERE risk_level = 'STOCKOUT' "
    "GROUP BY 1 HAVING count(*) >= 3"
)
O["agg13_ordered_concat"] = (
    "SELECT string_agg(seller_name || ' | ' || seller_category || '; ', '' ORDER BY "
    "fraud_flag_rate DESC, seller_id) AS report FROM (SELECT * FROM m_sellers WHERE "
    "fraud_flag_rate > 5 ORDER BY fraud_flag_rate DESC, seller_id LIMIT 10)"
)
O["agg14_groups_meeting_condition"] = f"SELECT count(*) AS sellers FROM ({O['agg12_having']})"
O["agg15_highest_id"] = "SELECT coalesce(max(order_id), 0) AS max_order_id FROM m_orders"
O["agg16_conditional_average"] = (
    "SELECT category, "
    + A("CASE WHEN customer_rating >= 4 THEN order_value END")
    + " AS liked_value FROM m_orders GROUP BY 1"
)

# -- ranks, sorts -----------------------------------------------------------------------------

O["win01_global_ntile"] = (
    "SELECT customer_id, ntile(5) OVER (ORDER BY total_order_value DESC NULLS FIRST, customer_id) "
    "AS value_tile, ntile(5) OVER (ORDER BY marketing_roi ASC NULLS LAST, customer_id) AS roi_tile "
    "FROM m_gold_customer"
)
O["win02_top_value_per_group"] = "SELECT * FROM m_top_values"
O["win03_global_row_number"] = (
    "SELECT event_id, row_number() OVER (ORDER BY event_timestamp, event_id) AS row_number "
    "FROM m_events"
)
O["win04_numbered_keys"] = (
    "SELECT seller_id, row_number() OVER (ORDER BY seller_id DESC) AS row_number FROM m_sellers"
)
O["srt01_order_by"] = "SELECT seller_id, seller_score FROM m_sellers"
O["srt02_top_k"] = top("m_orders", "order_id, order_value", "order_value DESC, order_id", 20)
O["srt03_preview"] = top("m_gold_customer", "customer_id, city, profile_clv", "customer_id", 10)
O["srt04_random_sample"] = top(
    "m_customers", "customer_id, city", f"{h('customer_id', 'sample')}, customer_id", 25
)

# -- functions -----------------------------------------------------------------------------------

O["fn01_math"] = (
    f"SELECT order_id, {R('(order_value / 3)', 2)} AS third, abs(profit - margin) AS gap, "
    "order_id % 200 + 1 AS slot, ((order_id - 1000) % 7 + 7) % 7 AS wrapped FROM m_orders"
)
O["fn04_null_aware_bounds"] = (
    "SELECT seller_id, CASE WHEN marketing_roi IS NOT NULL THEN greatest(0e0, marketing_roi) END AS "
    "roi_floor, CASE WHEN marketing_roi IS NOT NULL THEN least(1e0, marketing_roi) END AS roi_cap, "
    "greatest(0e0, least(20e0, growth_rate_pct)) AS growth_clamped, coalesce(marketing_roi, 0e0) / "
    "greatest(1e0, abs(coalesce(marketing_roi, 1e0))) AS roi_sign, "
    "coalesce(nullif(monthly_sales, 0e0), -1e0) AS monthly FROM m_sellers"
)
O["fn08_dates"] = (
    f"SELECT order_id, date_diff('day', order_date, {AS_OF_SQL}) AS age_days, "
    f"{day('(order_date + CAST(delivery_time_days AS INTEGER))')} AS due FROM m_orders"
)
O["fn09_times"] = (
    f"SELECT event_id, {day('event_timestamp')} AS day, strftime(event_timestamp, '%H:%M:%S') AS "
    f"time, date_sub('second', event_timestamp, {NOW_SQL}) AS age_s, event_timestamp >= {NOW_SQL} "
    "- INTERVAL 6 HOUR AS within_6h FROM m_events"
)
O["fn13_strings"] = (
    "SELECT customer_id, first_name || ' ' || last_name AS name, lower(city) AS city, "
    "lpad(CAST(customer_id AS VARCHAR), 8, '0') AS code, 'Src=' || campaign_source AS source "
    "FROM m_customers"
)
O["fn15_regex_extract"] = (
    "SELECT customer_id, extracted_value AS label, CAST(NULL AS VARCHAR) AS nothing FROM m_rfm"
)
O["fn17_casts"] = (
    "SELECT customer_id, TRY_CAST(pincode AS BIGINT) AS pin, TRY_CAST(app_version AS BIGINT) AS "
    "not_a_number, CAST(CAST(customer_lifetime_value AS DECIMAL(18,2)) AS VARCHAR) AS clv_text "
    "FROM m_customers"
)
O["fn18_array_index"] = (
    f"SELECT event_id, {_options(merge.PARTNERS, 'dp')} AS partner FROM m_events"
)
O["fn20_salted_hash"] = (
    f"SELECT event_id, {h('event_id', 'qty')} AS h, {h('event_id', 'qty')} % 5 AS p FROM m_events"
)
O["fn22_null_falls_through"] = (
    "SELECT seller_id, CASE WHEN marketing_roi < 0 THEN 'LOSS' WHEN marketing_roi >= 0 THEN 'GAIN' "
    "ELSE 'UNKNOWN' END AS roi_class FROM m_sellers"
)

# -- jobs -------------------------------------------------------------------------------------------

FACT_DAYS = ["first_order_date", "last_order_date"]
GOLD_DAYS = ["date_of_birth", "signup_date", "last_login_date", "profile_last_order_date", *FACT_DAYS]
SELLER_DAYS = ["seller_onboard_date", *FACT_DAYS]
O["job01_customer_order_facts"] = texted("m_order_facts", FACT_DAYS)
O["job02_customer_marketing_facts"] = "SELECT * FROM m_marketing_facts"
O["job03_gold_customer_360"] = texted("m_gold_customer", GOLD_DAYS, ["created_at"])
O["job04_order_fact"] = texted("m_fact", ["order_date"])
O["job05_seller_order_metrics"] = texted("m_seller_orders", FACT_DAYS)
O["job06_seller_customer_metrics"] = "SELECT * FROM m_seller_customers"
O["job06_seller_customer_metrics_once"] = "SELECT * FROM m_seller_customers_once"
O["job07_seller_top_values"] = "SELECT * FROM m_top_values"
O["job08_gold_seller_360"] = texted("m_gold_seller", SELLER_DAYS, ["created_at"])
O["job09_customer_ai_360"] = texted("m_ai", GOLD_DAYS, ["created_at", "ai_enriched_at"])
O["job10_rfm_scores"] = "SELECT * FROM m_rfm_scores"
O["job10_rfm_scores_corrected"] = (
    "SELECT customer_id, r_score, 6 - f_score AS f_score, 6 - m_score AS m_score, "
    "r_score + 12 - f_score - m_score AS rfm_score FROM m_rfm_scores"
)
O["job11_rfm_segments"] = "SELECT * FROM m_rfm"
O["job12_seller_final_action"] = "SELECT seller_id, seller_context, final_action FROM m_seller_ai"
O["job13_forecast_customer_outlook"] = texted("m_fc", moments=["forecast_generated_at"])
O["job14_forecast_customer_outlook_v2"] = texted("m_fc2", moments=["forecast_generated_at"])
O["job15_forecast_seller_outlook"] = texted("m_fs", moments=["forecast_generated_at"])
O["job16_customer_seller_mapping"] = "SELECT * FROM m_mapping"
_marts = {
    "gold_customer_360": "m_gold_customer",
    "seller_orders": "m_sold",
    "gold_seller_360": "m_gold_seller",
    "customer_ai_360": "m_ai",
    "rfm_segments": "m_rfm",
    "seller_enriched": "m_seller_ai",
    "forecast_customer_outlook": "m_fc",
    "forecast_seller_outlook": "m_fs",
    "customer_recent_activity": "m_cact",
    "seller_recent_activity": "m_sact",
    "customer_live": "m_cl",
    "seller_live": "m_sl",
}
O["job17_refresh_all"] = " UNION ALL ".join(
    f"SELECT '{mart}' AS mart, count(*) AS rows FROM {part}" for mart, part in _marts.items()
)

_all = "(SELECT customer_id, order_value, order_date FROM m_orders UNION ALL SELECT customer_id, " \
    "order_value, order_date FROM m_merged)"
O["job17_refresh_after_writeback"] = (
    f"SELECT (SELECT count(*) FROM m_customers) AS customers, count(*) AS orders, {E('order_value')} "
    f"AS order_value, {day('max(order_date)')} AS last_order, count(*) AS seller_orders FROM {_all}"
)

def after_writeback(name: str) -> str:
    """A named part over the base orders and mapping with the merged ones added."""
    renamed = {"m_orders": "m_orders_more", "m_mapping": "m_mapping_more"}
    while more := {
        n: f"{n}_more"
        for n, text in PARTS.items()
        if n != "m_merged" and n not in renamed and not n.endswith("_more") and set(_NAME.findall(text)) & renamed.keys()
    }:
        renamed |= more
    for old, new in renamed.items():
        PARTS.setdefault(new, _NAME.sub(lambda m: renamed.get(m[0], m[0]), PARTS[old]))
    return renamed[name]


PARTS["m_orders_more"] = f"SELECT * FROM m_orders UNION ALL BY NAME ({texted('m_merged', drop=['event_id', 'seller_id'])})"
PARTS["m_mapping_more"] = (
    "SELECT * FROM m_mapping UNION ALL SELECT customer_id, order_id, product_id, category, seller_id FROM m_merged"
)
O["job17_incremental_refresh"] = texted(after_writeback("m_gold_customer"), GOLD_DAYS, ["created_at"])
O["job17_incremental_sellers"] = texted(after_writeback("m_gold_seller"), SELLER_DAYS, ["created_at"])
O["job17_incremental_scores"] = f"SELECT * FROM {after_writeback('m_rfm')}"
O["job17_incremental_customer_forecast"] = texted(after_writeback("m_fc"), moments=["forecast_generated_at"])
O["job17_incremental_seller_forecast"] = texted(after_writeback("m_fs"), moments=["forecast_generated_at"])
O["agg02_merged_distincts"] = (
    "SELECT seller_id, count(DISTINCT order_id) AS unique_orders, count(DISTINCT customer_id) AS unique_customers, "
    "count(DISTINCT product_id) AS unique_products_sold, count(DISTINCT category) AS unique_categories_sold, "
    "count(DISTINCT brand) AS unique_brands_sold FROM m_sold GROUP BY seller_id"
)

# -- labels -----------------------------------------------------------------------------------------

for _key, _label in {
    "ai01_persona": "persona",
    "ai02_fraud_risk_label": "fraud_risk_label",
    "ai04_settlement_probability": "settlement_probability",
    "ai05_rto_risk_label": "rto_risk_label",
    "ai06_targeting_decision": "targeting_decision",
    "ai12_fraud_reason": "fraud_reason",
    "ai14_marketing_strategy": "marketing_strategy",
}.items():
    O[_key] = f"SELECT customer_id, {LABELS[_label]} AS {_label} FROM m_gold_customer"
def _cut(measure: str) -> str:
    """Value of the first rank that has the measure's share of all known values at or below it."""
    return (
        f"(SELECT {measure} FROM (SELECT {measure}, row_number() OVER (ORDER BY {measure}) AS place, count(*) OVER () AS n "
        f"FROM m_gold_customer WHERE {measure} IS NOT NULL) WHERE place = greatest(1, ceil({enrichment.PERSONA_SHARES[measure]} * n)))"
    )


O["ai01_persona_by_share"] = (
    f"SELECT customer_id, CASE WHEN cod_pct > {_cut('cod_pct')} THEN 'Risky COD Buyer' WHEN discount_sensitivity_score > "
    f"{_cut('discount_sensitivity_score')} THEN 'Discount Hunter' WHEN avg_order_value > {_cut('avg_order_value')} "
    "THEN 'Premium' ELSE 'Loyal Shopper' END AS persona FROM m_gold_customer"
)
O["ai03_rfm_segment_rules"] = "SELECT customer_id, extracted_value FROM m_rfm"
O["ai07_seller_classification"] = (
    f"SELECT seller_id, {_seller_labels['seller_classification']} AS seller_classification "
    "FROM m_gold_seller"
)
O["ai08_performance_sentiment"] = "SELECT seller_id, performance_sentiment_score FROM m_sentiment"
O["ai09_seller_embedding"] = (
    "SELECT seller_id, 1024 AS dimensions, len(list_distinct(string_split(lower(concat_ws(' ', "
    "coalesce(most_sold_category, ''), performance_segment, growth_segment)), ' '))) AS words, "
    "1e0 AS length FROM m_gold_seller"
)
PARTS["m_seller_words"] = (
    "SELECT seller_id, word, count(*) AS w FROM (SELECT seller_id, unnest(string_split(lower(concat_ws(' ', "
    "coalesce(most_sold_category, ''), coalesce(performance_segment, ''), coalesce(growth_segment, ''))), ' ')) AS word "
    "FROM m_gold_seller) GROUP BY seller_id, word"
)
PARTS["m_seller_norms"] = "SELECT seller_id, sqrt(sum(w * w)) AS norm FROM m_seller_words GROUP BY seller_id"
PARTS["m_similar_sellers"] = (
    "SELECT a.seller_id, b.seller_id AS similar_seller, round(sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)), 8) "
    "AS similarity FROM m_seller_words a JOIN m_seller_words b ON a.word = b.word AND a.seller_id <> b.seller_id "
    "JOIN m_seller_norms x ON x.seller_id = a.seller_id JOIN m_seller_norms y ON y.seller_id = b.seller_id GROUP BY 1, 2"
)
PARTS["m_five_sellers"] = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY similarity DESC, similar_seller) AS place "
    "FROM m_similar_sellers) WHERE place <= 5"
)
O["ai09_similar_sellers"] = "SELECT seller_id, place, similar_seller, round(similarity, 6) AS similarity FROM m_five_sellers"
O["ai09_hashed_neighbours"] = (
    "SELECT count(DISTINCT seller_id) AS ids, count(*) AS neighbours, TRUE AS enough FROM m_five_sellers"
)
O["ai10_quoted_label"] = "SELECT customer_id, extracted_value AS label FROM m_rfm"
O["ai11_identity_insights"] = (
    "SELECT customer_id, "
    + "coalesce(nullif(concat_ws(',', "
    + ", ".join(
        f"CASE WHEN {col} > {cut} THEN '{name}' END"
        for name, col, cut in [*enrichment.FRAUD_DRIVERS, enrichment.CANCELLATION_DRIVER]
    )
    + f"), ''), 'NONE') AS fraud_reason, {LABELS['fraud_risk_label']} AS fraud_risk_label "
    "FROM m_gold_customer"
)
O["ai13_main_risk_and_strength"] = (
    "SELECT seller_id, extracted_risk, extracted_strength FROM m_seller_ai"
)
O["ai14_seller_suggested_action"] = "SELECT seller_id, suggested_action FROM m_seller_ai"

# -- marts ------------------------------------------------------------------------------------------

PLATFORM_DAYS = ["first_order_on_platform", "last_order_on_platform"]
O["mrt01_inventory_risk"] = "SELECT * FROM m_inv"
O["mrt02_stockout_alerts"] = texted("m_stock_alerts", moments=["alert_timestamp"])
O["mrt02_stockout_alerts_rerun"] = (
    f"SELECT * REPLACE ({moment('alert_timestamp')} AS alert_timestamp, CASE WHEN risk_level = "
    "'CRITICAL' AND pending_orders = 0 THEN 'CLOSED' ELSE 'OPEN' END AS alert_status) "
    "FROM m_stock_alerts"
)
O["mrt03_platform_profiles"] = texted("m_platforms", PLATFORM_DAYS)
O["mrt04_cross_platform_identity"] = "SELECT * FROM m_identity"
O["mrt05_cross_platform_marketing"] = "SELECT * FROM m_cross"

# -- streaming ----------------------------------------------------------------------------------------

O["str01_change_stream"] = O["src01_realtime_order_events"]
_landed = ", ".join(c for c in testdata.order_events("1").columns if c != "event_id")
O["str02_land_with_ids"] = (
    "SELECT * REPLACE (" + moment("event_timestamp") + " AS event_timestamp) FROM (SELECT "
    "row_number() OVER (ORDER BY NOT is_returned, event_timestamp, customer_id, seller_id, "
    f"order_value, category, payment_type, is_cancelled, customer_rating, delivery_time_days) AS event_id, {_landed} FROM m_events)"
)
O["str03_customer_activity"] = texted("m_cact", moments=["last_event_time"])
O["str03_stream_customer_activity"] = O["str03_customer_activity"]
O["str04_seller_activity"] = texted("m_sact", moments=["last_event_time"])
O["str04_stream_seller_activity"] = O["str04_seller_activity"]
LIVE_MOMENTS = ["last_realtime_event", "last_refreshed_at"]
O["str05_customer_live"] = texted("m_cl", moments=LIVE_MOMENTS)
O["str05_changed_buckets_customer_live"] = O["str05_customer_live"]
O["str05_stream_customer_live"] = O["str05_customer_live"]
O["str06_seller_live"] = texted("m_sl", moments=LIVE_MOMENTS)
O["str06_changed_buckets_seller_live"] = O["str06_seller_live"]
O["str06_stream_seller_live"] = O["str06_seller_live"]
O["str07_run_when_data_arrives"] = "SELECT 0 AS run, count(*) AS events FROM m_events"
O["str08_standing_query"] = "SELECT count(*) AS events FROM m_events"
O["str09_has_new_data"] = (
    "SELECT max(event_id) AS landed, max(event_id) FILTER (WHERE NOT is_returned) AS merged, "
    "coalesce(bool_or(is_returned), FALSE) AS has_new_data FROM m_events"
)
O["str10_merged_orders"] = texted("m_merged", ["order_date"], drop=["event_id", "seller_id"])
O["str10_stream_merged_orders"] = O["str10_merged_orders"]
O["str11_writeback_with_a_new_checkpoint"] = O["str10_merged_orders"]
O["str11_merge_ledger"] = "SELECT event_id FROM m_events"
O["str12_merged_mapping"] = (
    "SELECT customer_id, order_id, product_id, category, seller_id FROM m_merged"
)
O["str13_changed_customers"] = top(
    "m_cl",
    "customer_id, customer_name, baseline_churn_prediction, realtime_churn_prediction, "
    "baseline_clv, realtime_clv, realtime_order_count, realtime_order_value, prediction_changed",
    "realtime_order_value DESC, customer_id",
    20,
    "prediction_changed",
)
O["str13_changed_sellers"] = top(
    "m_sl",
    "seller_id, seller_name, baseline_risk_forecast, realtime_risk_forecast, baseline_revenue, "
    "realtime_revenue, realtime_order_count, realtime_order_value, realtime_revenue_lift_pct, "
    "prediction_changed",
    "realtime_order_value DESC, seller_id",
    20,
    "prediction_changed",
)
O["str14_stream_totals"] = (
    f"SELECT count(*) AS total_events, {moment('min(event_timestamp)')} AS first_event, "
    f"{moment('max(event_timestamp)')} AS last_event FROM m_events"
)
for _key, _part in {"customer": "m_cl", "seller": "m_sl"}.items():
    O[f"str14_changed_{_key}_totals"] = (
        f"SELECT count(*) AS total, {N('prediction_changed')} AS predictions_changed FROM {_part}"
    )
for _key, _part in {"customer": "m_cact", "seller": "m_sact"}.items():
    O[f"str14_{_key}_activity_peak"] = (
        f"SELECT count(*) AS keys, max(recent_order_value) AS max_order_value FROM {_part}"
    )
O["str15_recency_tiers"] = (
    f"SELECT customer_id, last_event_time >= {NOW_SQL} - INTERVAL 1 HOUR AS within_1h, "
    f"last_event_time >= {NOW_SQL} - INTERVAL 6 HOUR AS within_6h FROM m_cact"
)
O["str16_nonempty_batches"] = O["src06_batch_snapshot"]
O["str17_windowed_activity"] = (
    f"SELECT {moment('start')} AS window_start, {moment('start + INTERVAL 24 HOUR')} AS window_end, "
    f"customer_id, count(*) AS orders, {E('order_value')} AS value FROM (SELECT *, unnest(["
    "time_bucket(INTERVAL 12 HOUR, event_timestamp), time_bucket(INTERVAL 12 HOUR, event_timestamp) "
    "- INTERVAL 12 HOUR]) AS start FROM m_events) GROUP BY start, customer_id"
)
O["str18_session_activity"] = (
    f"SELECT {moment('min(event_timestamp)')} AS window_start, "
    f"{moment('max(event_timestamp) + INTERVAL 6 HOUR')} AS window_end, customer_id, count(*) AS "
    f"orders, {E('order_value')} AS value FROM (SELECT *, sum(fresh) OVER (PARTITION BY customer_id "
    "ORDER BY event_timestamp, event_id) AS session FROM (SELECT *, CASE WHEN event_timestamp > "
    "lag(event_timestamp) OVER (PARTITION BY customer_id ORDER BY event_timestamp, event_id) + "
    "INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM m_events)) GROUP BY customer_id, session"
)

# -- reports --------------------------------------------------------------------------------------------

RISK_SUM = R(E("revenue_at_risk"), 0)
O["rpt01_customer_totals"] = (
    "SELECT count(*) AS total_customers, count(DISTINCT loyalty_tier) AS tiers, "
    f"{R(A('customer_lifetime_value'), 2)} AS avg_clv FROM m_customers"
)
O["rpt02_customers_by_tier"] = (
    f"SELECT loyalty_tier, count(*) AS count, {R(A('customer_lifetime_value'), 2)} AS avg_clv "
    "FROM m_customers GROUP BY 1"
)
O["rpt03_top_customers"] = top(
    "m_customers",
    "customer_id, first_name || ' ' || last_name AS name, city, loyalty_tier, total_orders, "
    f"{R('customer_lifetime_value', 2)} AS clv",
    "customer_lifetime_value DESC, customer_id",
    10,
)
O["rpt04_tier_category_value"] = (
    f"SELECT seller_tier, category, count(*) AS orders, {R(E('order_value'), 0)} AS total_value "
    "FROM m_fact GROUP BY ALL"
)
O["rpt05_customer_forecast_kpis"] = (
    "SELECT count(*) AS total_customers, "
    + N("churn_prediction_30d IN ('VERY HIGH', 'HIGH')")
    + f" AS high_churn_count, {R(A('churn_probability_score'), 3)} AS avg_churn_prob, {RISK_SUM} "
    f"AS total_revenue_at_risk, {N('current_loyalty_tier <> predicted_loyalty_tier')} AS "
    "tier_migration_count, "
    + N("retention_priority = 'CRITICAL'")
    + " AS critical_count FROM m_fc"
)


def _dist(column: str, label: str, source: str) -> str:
    return f"SELECT {column} AS {label}, count(*) AS count FROM {source} GROUP BY 1"


O["rpt06_churn_levels"] = _dist("churn_prediction_30d", "churn_level", "m_fc")
O["rpt07_retention_priorities"] = _dist("retention_priority", "priority", "m_fc")
O["rpt08_tier_migrations"] = top(
    "(SELECT current_loyalty_tier || ' -> ' || predicted_loyalty_tier AS migration, count(*) AS "
    "count FROM m_fc WHERE current_loyalty_tier <> predicted_loyalty_tier GROUP BY 1)",
    "*",
    "count DESC, migration",
    10,
)
O["rpt09_persona_stability"] = _dist("persona_stability", "stability", "m_fc")
O["rpt10_interventions"] = (
    f"SELECT recommended_intervention AS intervention, count(*) AS count, {RISK_SUM} AS "
    "total_revenue_at_risk FROM m_fc GROUP BY 1"
)
_detail = (
    "customer_id, customer_name, persona, current_loyalty_tier, predicted_loyalty_tier, "
    "current_rfm_segment, predicted_rfm_segment, churn_prediction_30d, "
    f"{R('churn_probability_score', 2)} AS churn_prob, {R('current_clv', 0)} AS current_clv, "
    f"{R('projected_clv_90d', 0)} AS projected_clv_90d, {R('revenue_at_risk', 0)} AS "
    "revenue_at_risk, retention_priority, recommended_intervention"
)
BY_RISK_C = "revenue_at_risk DESC NULLS FIRST, customer_id"
BY_RISK_S = "revenue_at_risk DESC NULLS FIRST, seller_id"
O["rpt11_customer_forecast_detail"] = top("m_fc", _detail, BY_RISK_C, 50)
O["rpt11_customer_forecast_detail_high"] = top(
    "m_fc", _detail, BY_RISK_C, 50, "retention_priority = 'HIGH'"
)
O["rpt12_seller_forecast_kpis"] = (
    "SELECT count(*) AS total_sellers, "
    + N("risk_forecast IN ('CRITICAL', 'HIGH')")
    + f" AS high_risk_count, {RISK_SUM} AS total_revenue_at_risk, {R(A('sustainability_score'), 3)} AS "
    f"avg_sustainability, {N('current_seller_tier <> predicted_seller_tier')} AS "
    "tier_migration_count, "
    + N("investment_recommendation = 'INVEST HEAVILY'")
    + " AS invest_count FROM m_fs"
)
O["rpt13_seller_risk_levels"] = _dist("risk_forecast", "risk_level", "m_fs")
O["rpt14_investments"] = _dist("investment_recommendation", "recommendation", "m_fs")
O["rpt15_growth_trends"] = (
    "SELECT revenue_growth_trend AS trend, count(*) AS count, "
    f"{R(A('projected_revenue_90d'), 0)} AS avg_projected_rev FROM m_fs GROUP BY 1"
)
O["rpt16_operational_health"] = _dist("operational_health_forecast", "health", "m_fs")
O["rpt17_seller_actions"] = (
    f"SELECT recommended_action AS action, count(*) AS count, {RISK_SUM} AS total_revenue_at_risk, "
    f"{R(A('sustainability_score'), 3)} AS avg_sustainability FROM m_fs GROUP BY 1"
)
_sdetail = (
    "seller_id, seller_name, seller_type, seller_category, current_seller_tier, "
    f"predicted_seller_tier, {R('current_revenue', 0)} AS current_revenue, "
    f"{R('projected_revenue_90d', 0)} AS projected_rev_90d, revenue_growth_trend, risk_forecast, "
    f"{R('operational_health_score', 1)} AS ops_health, profit_trajectory, "
    f"{R('sustainability_score', 2)} AS sustainability, {R('revenue_at_risk', 0)} AS "
    "revenue_at_risk, investment_recommendation, recommended_action"
)
O["rpt18_seller_forecast_detail"] = top("m_fs", _sdetail, BY_RISK_S, 50)
O["rpt18_seller_forecast_detail_high"] = top(
    "m_fs", _sdetail, BY_RISK_S, 50, "risk_forecast = 'HIGH'"
)
O["rpt19_live_stats"] = O["prj08_scalar_subqueries"]

SHORT = "risk_level IN ('STOCKOUT', 'CRITICAL')"
_board = [
    ("m_sellers", N("fraud_flag_rate > 5")),
    ("m_cl", N("realtime_churn_prediction IN ('VERY HIGH', 'HIGH')")),
    ("m_cl", N("realtime_retention_priority = 'CRITICAL'")),
    ("m_cl", N("prediction_changed")),
    ("m_sl", N("realtime_risk_forecast IN ('CRITICAL', 'HIGH')")),
    ("m_sl", N("prediction_changed")),
    ("m_fs", N("operational_health_forecast = 'AT RISK'")),
    ("m_sellers", N("rto_rate_pct > 10")),
    ("m_sellers", N("stock_out_rate > 15")),
    ("m_sellers", N("cod_users_pct > 60")),
    ("m_fs", N("sustainability_score < 0.4 AND current_revenue > 100000")),
    ("m_inv", N("risk_level = 'STOCKOUT'")),
    ("m_inv", N("risk_level = 'CRITICAL'")),
    ("m_inv", f"sum(estimated_unfulfillable_orders) FILTER (WHERE {SHORT})"),
    ("m_inv", R(E(f"CASE WHEN {SHORT} THEN potential_revenue_loss END"), 0)),
    (
        "m_inv",
        R(
            "(sum(CAST(round(left_days * 1e6) AS BIGINT)) / 1e6 / count(left_days))",
            1,
        ),
    ),
    ("m_inv", N("risk_level = 'WARNING' AND stock_after_pending < 5")),
    ("m_inv", f"count(DISTINCT category) FILTER (WHERE {SHORT})"),
    (f"({O['agg12_having']})", "count(*)"),
    ("m_stock_alerts", N("alert_status = 'OPEN'")),
]
_LEFT = (
    "(SELECT *, CASE WHEN risk_level IN ('WARNING', 'CRITICAL') AND pending_orders > 0 THEN "
    "CAST(current_stock_level AS DOUBLE) / pending_orders END AS left_days FROM m_inv)"
)
O["rpt20_alert_board"] = " UNION ALL ".join(
    f"SELECT {i} AS line, '{name}' AS alert, CAST({expr} AS DOUBLE) AS count FROM "
    + (_LEFT if "left_days" in expr else source)
    for i, (name, (source, expr)) in enumerate(zip(alerts.BOARD, _board), start=1)
)
O["set01_union_of_counts"] = O["rpt20_alert_board"]
O["rpt21_changed_customers"] = top(
    "m_cl",
    "customer_id, customer_name, baseline_churn_prediction AS before, realtime_churn_prediction AS "
    f"now, {R('realtime_clv', 0)} AS realtime_clv, realtime_retention_priority AS priority",
    "realtime_clv DESC, customer_id",
    10,
    "prediction_changed",
)
O["rpt22_changed_sellers"] = top(
    "m_sl",
    "seller_id, seller_name, baseline_risk_forecast AS before, realtime_risk_forecast AS now, "
    f"{R('realtime_revenue', 0)} AS realtime_rev, realtime_order_count AS new_orders",
    "realtime_order_value DESC, seller_id",
    10,
    "prediction_changed",
)
LOSS = R(E("potential_revenue_loss"), 0)
O["rpt23_inventory_summary"] = (
    f"SELECT risk_level, count(*) AS products, {SUM('estimated_unfulfillable_orders')} AS "
    f"unfulfillable_orders, {LOSS} AS revenue_at_risk FROM m_inv GROUP BY 1"
)
O["rpt24_open_stock_alerts"] = top(
    "m_stock_alerts",
    f"{moment('alert_timestamp')} AS alert_timestamp, seller_name, product_id, product_name, "
    "category, current_stock, pending_orders, risk_level, estimated_stockout_orders, "
    f"{R('potential_revenue_loss', 0)} AS revenue_loss, alert_status",
    "alert_timestamp DESC, potential_revenue_loss DESC, product_id, seller_id",
    50,
)
O["rpt25_at_risk_by_category"] = (
    "SELECT category, risk_level, count(*) AS products FROM m_inv WHERE risk_level <> 'HEALTHY' "
    "GROUP BY ALL"
)
O["rpt26_stockout_sellers"] = top(
    "(SELECT seller_name, " + N("risk_level = 'STOCKOUT'") + " AS stockout_products, "
    + N("risk_level = 'WARNING'")
    + f" AS warning_products, {SUM('estimated_unfulfillable_orders')} AS total_unfulfillable, "
    f"{LOSS} AS total_revenue_loss FROM m_inv WHERE risk_level <> 'HEALTHY' GROUP BY 1)",
    "*",
    "stockout_products DESC, seller_name",
    15,
)
O["rpt27_cross_platform_segments"] = (
    "SELECT cross_platform_segment, count(*) AS customers, "
    f"{R(A('total_spend_all_platforms'), 0)} AS avg_spend, {R('avg(platform_count)', 1)} AS "
    "avg_platforms FROM m_identity GROUP BY 1"
)
O["rpt28_marketing_segments"] = (
    f"SELECT marketing_action_segment, count(*) AS customers, {R(A('total_revenue'), 0)} AS "
    f"avg_revenue, {R(A('switch_rate_pct'), 1)} AS avg_switch_rate FROM m_cross GROUP BY 1"
)
O["rpt29_vip_customers"] = top(
    "m_identity",
    "customer_name, loyalty_tier, cross_platform_segment, platform_count, "
    "total_orders_all_platforms AS total_orders, "
    f"{R('total_spend_all_platforms', 0)} AS total_spend, highest_spend_platform, "
    "most_frequent_platform, rfm_segment",
    "total_spend_all_platforms DESC, customer_id",
    20,
    "cross_platform_value = 'HIGH'",
)
O["rpt30_campaign_recommendations"] = (
    "SELECT marketing_action_segment, recommended_campaign_action, count(*) AS target_customers, "
    f"{R(A('total_revenue'), 0)} AS avg_revenue FROM m_cross GROUP BY ALL"
)
O["rpt31_customer_profile"] = (
    "SELECT customer_id, first_name || ' ' || last_name AS name, city, state, loyalty_tier, "
    f"loyalty_points, {R('customer_lifetime_value', 0)} AS clv, total_orders, preferred_category, "
    f"preferred_payment_method FROM m_customers WHERE customer_id = {ONE_CUSTOMER}"
)
O["rpt32_customer_recent_orders"] = top(
    "m_orders",
    f"order_id, {day('order_date')} AS order_date, product_name, category, brand, "
    f"{R('order_value', 0)} AS order_value, order_status, delivery_time_days, is_returned",
    "order_date DESC, order_id",
    10,
    f"customer_id = {ONE_CUSTOMER}",
)
O["rpt33_customer_loyalty"] = LOYALTY
O["rpt34_customer_platforms"] = (
    f"SELECT platform, channel, orders_on_platform, {R('total_spend_on_platform', 0)} AS spend, "
    f"{R('avg_order_value_on_platform', 0)} AS aov, {day('first_order_on_platform')} AS "
    f"first_order_on_platform, {day('last_order_on_platform')} AS last_order_on_platform "
    f"FROM m_platforms WHERE customer_id = {ONE_CUSTOMER}"
)
O["rpt35_top_sellers_by_rating"] = top(
    "m_sellers",
    "seller_id, seller_name, seller_tier, seller_category, avg_customer_rating, total_orders, "
    "total_revenue, seller_score",
    "avg_customer_rating DESC, seller_id",
    10,
)
O["rpt35_top_sellers_by_orders"] = top(
    "m_sellers",
    "seller_id, seller_name, seller_tier, seller_category, total_orders, total_revenue, "
    "repeat_customer_pct, seller_score",
    "total_orders DESC, seller_id",
    10,
)
O["rpt36_seller_kpis_by_tier"] = (
    f"SELECT seller_tier, count(*) AS seller_count, {R(A('total_revenue'), 2)} AS avg_revenue, "
    f"{R('avg(total_orders)', 0)} AS avg_orders, {R(A('avg_customer_rating'), 2)} AS avg_rating, "
    f"{R(A('seller_score'), 2)} AS avg_seller_score, {N('is_top_seller')} AS top_sellers_count "
    "FROM m_sellers GROUP BY 1"
)
O["rpt37_customer_order_sample"] = top(
    "(SELECT o.*, first_name, last_name, city AS customer_city, loyalty_tier FROM m_orders o "
    "JOIN m_customers c ON o.customer_id = c.customer_id)",
    "customer_id, first_name, last_name, customer_city, loyalty_tier, order_id, "
    f"{day('order_date')} AS order_date, product_name, category, order_value, payment_type, "
    "order_status",
    "order_id",
    10,
)
O["rpt37_busiest_customers"] = top(
    "(SELECT customer_id, count(DISTINCT order_id) AS orders, " + E("order_value")
    + " AS order_value FROM m_orders GROUP BY 1)",
    "*",
    "orders DESC, customer_id",
    10,
)
_names = ", ".join(f"'{n}'" for n in NAMED_SELLERS)
O["rpt38_sellers_named"] = top(
    "m_sellers",
    "seller_id, seller_name, seller_tier, seller_category, seller_type, total_revenue, "
    "total_orders, avg_order_value, seller_score, avg_customer_rating, return_rate_pct, "
    "cancellation_rate_pct, fraud_flag_rate",
    "seller_id",
    20,
    f"seller_name IN ({_names})",
)
O["rpt39_latest_merged_orders"] = top(
    "m_merged",
    f"order_id, customer_id, {day('order_date')} AS order_date, category, order_value, "
    "payment_type, order_status, shipping_city, margin, profit",
    "order_id DESC",
    5,
)
O["rpt39_orders_before_after"] = (
    "SELECT count(*) AS orders_before, count(*) + (SELECT count(*) FROM m_merged) AS orders_after, "
    "(SELECT count(*) FROM m_mapping) + (SELECT count(*) FROM m_merged) AS mapping_count "
    "FROM m_orders"
)
for _table, (_part, _key, _days, _moments) in {
    "customers": ("m_customers", "customer_id", CUSTOMER_DAYS, []),
    "marketing_interactions": ("m_marketing", "interaction_id", [], ["send_timestamp"]),
    "gold_customer_360": ("m_gold_customer", "customer_id", GOLD_DAYS, ["created_at"]),
    "customer_ai_360": ("m_ai", "customer_id", GOLD_DAYS, ["created_at", "ai_enriched_at"]),
    "forecast_customer_outlook": ("m_fc", "customer_id", [], ["forecast_generated_at"]),
    "forecast_seller_outlook": ("m_fs", "seller_id", [], ["forecast_generated_at"]),
    "sellers": ("m_sellers", "seller_id", ["seller_onboard_date"], []),
    "customer_seller_mapping": ("m_mapping", "order_id", [], []),
}.items():
    O[f"rpt40_preview_{_table}"] = (
        texted(_part, _days, _moments) + f" ORDER BY {_key} LIMIT 10"
    )

# -- alerts ---------------------------------------------------------------------------------------------

O["alr01_seller_fraud"] = top(
    "m_sellers",
    "seller_id, seller_name, seller_category, fraud_flag_rate, rto_rate_pct, "
    f"cancellation_rate_pct, {R('total_revenue', 0)} AS total_revenue",
    "fraud_flag_rate DESC, seller_id",
    10,
    "fraud_flag_rate > 5",
)
O["alr02_churn"] = top(
    "m_fc",
    "customer_id, customer_name, coalesce(persona, 'N/A') AS persona, churn_prediction_30d, "
    f"{R('revenue_at_risk', 0)} AS revenue_at_risk, coalesce(recommended_intervention, 'N/A') AS "
    "recommended_intervention",
    BY_RISK_C,
    10,
    "churn_prediction_30d IN ('VERY HIGH', 'HIGH')",
)
O["alr04_seller_risk"] = top(
    "m_fs",
    f"seller_id, seller_name, seller_category, risk_forecast, {R('operational_health_score', 1)} "
    f"AS operational_health_score, {R('revenue_at_risk', 0)} AS revenue_at_risk, "
    "recommended_action",
    BY_RISK_S,
    10,
    "risk_forecast IN ('CRITICAL', 'HIGH')",
)
O["alr09_stock_out"] = top(
    "m_sellers",
    f"seller_id, seller_name, seller_category, {R('stock_out_rate', 1)} AS stock_out_rate, "
    f"{R('inventory_turnover_ratio', 2)} AS inventory_turnover_ratio, avg_stock_level",
    "stock_out_rate DESC, seller_id",
    10,
    "stock_out_rate > 15",
)


def _down(kind: str, strict: bool = False) -> str:
    now, then = f"current_{kind}_tier", f"predicted_{kind}_tier"
    text = (
        f"({now} = 'platinum' AND {then} IN ('gold', 'silver', 'bronze')) OR "
        f"({now} = 'gold' AND {then} IN ('silver', 'bronze'))"
    )
    return text + (f" OR ({now} = 'silver' AND {then} = 'bronze')" if strict else "")


def _alert(
    n: int, count: str, source: str, risk: str = "CAST(NULL AS DOUBLE)",
    parts: tuple[str, str] = ("CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)"),
) -> str:
    name = dict(alerts.ALERTS)[n]
    return (
        f"SELECT {n} AS alert_id, '{name}' AS alert_name, {count} AS triggered_count, {risk} AS "
        f"revenue_at_risk, {parts[0]} AS customers_downgraded, {parts[1]} AS sellers_downgraded FROM {source}"
    )


def _money(test: str) -> str:
    return R(f"coalesce({E(f'CASE WHEN {test} THEN revenue_at_risk END')}, 0e0)", 0)


def _downgrades(strict: bool = False) -> str:
    parts = (
        f"(SELECT {N(_down('loyalty', strict))} FROM m_fc)",
        f"(SELECT {N(_down('seller', strict))} FROM m_fs)",
    )
    return _alert(5, " + ".join(parts), "(SELECT 1)", parts=parts)


_churny, _risky = "churn_prediction_30d IN ('VERY HIGH', 'HIGH')", "risk_forecast IN ('CRITICAL', 'HIGH')"
_crit = "retention_priority = 'CRITICAL'"
ALERT_SQL = {
    1: _alert(1, N("fraud_flag_rate > 5"), "m_sellers"),
    2: _alert(2, N(_churny), "m_fc", _money(_churny)),
    3: _alert(3, N(_crit), "m_fc", _money(_crit)),
    4: _alert(4, N(_risky), "m_fs", _money(_risky)),
    5: _downgrades(),
    6: _alert(6, N("operational_health_forecast = 'AT RISK'"), "m_fs"),
    7: _alert(7, N("rto_rate_pct > 10"), "m_sellers"),
    8: _alert(
        8, N("persona_stability = 'LIKELY SHIFTING' AND upsell_potential_score > 0.5"), "m_fc"
    ),
    9: _alert(9, N("stock_out_rate > 15"), "m_sellers"),
    10: _alert(10, N("cod_users_pct > 60"), "m_sellers"),
    11: _alert(11, N("sustainability_score < 0.4 AND current_revenue > 100000"), "m_fs"),
}
O["alr_all_alerts"] = " UNION ALL ".join(ALERT_SQL.values())
O["alr05_strict_downgrades"] = _downgrades(strict=True)
for _n, _key in {
    3: "alr03_critical_retention",
    5: "alr05_tier_downgrades",
    6: "alr06_operational_health",
    7: "alr07_high_rto",
    8: "alr08_retargeting",
    10: "alr10_cod_dependency",
    11: "alr11_low_sustainability",
}.items():
    O[_key] = ALERT_SQL[_n]
O["alr12_report_rollup"] = (
    f"SELECT {N('triggered_count > 0')} AS alerts_fired, CASE WHEN {N('triggered_count > 0')} > 0 "
    f"THEN CAST({N('triggered_count > 0')} AS VARCHAR) || ' alerts' ELSE 'nothing "
    f"to report' END AS message FROM ({O['alr_all_alerts']})"
)

# -- questions --------------------------------------------------------------------------------------------

O["qst1_high_risk_seller_revenue"] = (
    "SELECT seller_id, seller_name, risk_forecast, current_revenue, projected_revenue_90d "
    f"FROM m_fs WHERE {_risky}"
)
O["qst2_persona_revenue_at_risk"] = (
    f"SELECT persona, count(*) AS count, {R(E('revenue_at_risk'), 2)} AS total_revenue_at_risk "
    "FROM m_fc GROUP BY 1"
)
O["qst3_predicted_tier_drops"] = (
    "SELECT customer_id, customer_name, current_loyalty_tier, predicted_loyalty_tier, current_clv, "
    f"churn_probability_score FROM m_fc WHERE {_down('loyalty', True)}"
)
O["qst4_churn_heavy_categories"] = (
    "SELECT seller_category, count(DISTINCT k.customer_id) AS high_churn_customers FROM m_mapping k "
    "JOIN m_fc f ON k.customer_id = f.customer_id JOIN m_sellers s ON k.seller_id = s.seller_id "
    f"WHERE {_churny} GROUP BY 1"
)
O["qst5_top_clv_with_sellers"] = (
    "SELECT b.customer_id, customer_name, current_clv, current_rfm_segment AS rfm_segment, "
    "s.seller_id, seller_name, count(*) AS orders FROM (SELECT * FROM m_fc ORDER BY current_clv "
    "DESC, customer_id LIMIT 10) b JOIN m_mapping k ON k.customer_id = b.customer_id JOIN m_sellers "
    "s ON s.seller_id = k.seller_id GROUP BY ALL"
)
O["qst6_order_value_by_persona_and_tier"] = (
    f"SELECT persona, seller_tier, count(*) AS orders, {R(A('o.order_value'), 2)} AS "
    "avg_order_value FROM m_sold o JOIN m_ai a ON a.customer_id = o.customer_id JOIN m_sellers s ON "
    "s.seller_id = o.seller_id GROUP BY ALL"
)
O["qst7_critical_customers_with_sellers"] = (
    "SELECT DISTINCT f.customer_id, f.customer_name, f.current_clv, s.seller_id, s.seller_name, "
    "s.risk_forecast FROM m_mapping k JOIN m_fc f ON k.customer_id = f.customer_id JOIN m_fs s ON "
    "k.seller_id = s.seller_id WHERE f.retention_priority = 'CRITICAL'"
)

# -- SQL over views and table functions --------------------------------------------------

O["udx02_customer_profile"] = O["rpt31_customer_profile"]
O["udx02_customer_recent_orders"] = O["rpt32_customer_recent_orders"]
O["udx02_customer_loyalty"] = O["rpt33_customer_loyalty"]
O["udx02_customer_platforms"] = O["rpt34_customer_platforms"]
O["udx02_customers_at_risk"] = O["rpt11_customer_forecast_detail_high"]
O["udx02_sellers_at_risk"] = O["rpt18_seller_forecast_detail"]
O["udx02_orders_of_tier"] = (
    f"SELECT o.category, count(*) AS orders, count(*) FILTER (o.order_date < {AS_OF_SQL}) AS before_today FROM m_orders o "
    "JOIN m_customers c ON o.customer_id = c.customer_id WHERE lower(c.loyalty_tier) = 'gold' GROUP BY 1"
)
O["str04_sketched_reach"] = (
    "SELECT seller_id, count(DISTINCT customer_id) AS exact, true AS near FROM m_events GROUP BY seller_id"
)


def oracle_sql() -> dict[str, str]:
    return {name: compose(PARTS, sql) for name, sql in O.items()}
