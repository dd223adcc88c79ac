"""Declared schemas of the base tables (fixed formats)."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(order: str, **names_by_type: str) -> T.StructType:
    """Columns in ``order``, each named under its type."""
    kinds = {name: kind for kind, names in names_by_type.items() for name in names.split()}
    return T.StructType([T.StructField(name, _TYPES[kinds[name]]) for name in order.split()])


def _columns(text: str) -> T.StructType:
    """Schema from ``name type, name type, ...``."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CUSTOMERS = _schema(
    order="""customer_id first_name last_name gender date_of_birth age marital_status
        household_income occupation education_level city state pincode country latitude
        longitude signup_date last_login_date customer_tenure_days customer_type
        loyalty_tier loyalty_points preferred_language preferred_device
        preferred_payment_method avg_session_duration sessions_last_30_days
        weekend_shopper_flag night_shopper_flag preferred_category secondary_category
        brand_affinity_score email phone_number whatsapp_opt_in email_opt_in
        discount_sensitivity_score price_sensitivity_score return_behavior_score
        fraud_risk_score last_order_date last_order_value customer_lifetime_value
        total_orders referral_source campaign_source device_os app_version
        churn_risk_score engagement_score""",
    bigint="customer_id",
    int="""age household_income customer_tenure_days loyalty_points sessions_last_30_days
        total_orders""",
    double="""latitude longitude avg_session_duration brand_affinity_score
        discount_sensitivity_score price_sensitivity_score return_behavior_score
        fraud_risk_score last_order_value customer_lifetime_value churn_risk_score
        engagement_score""",
    date="date_of_birth signup_date last_login_date last_order_date",
    boolean="weekend_shopper_flag night_shopper_flag whatsapp_opt_in email_opt_in",
    string="""first_name last_name gender marital_status occupation education_level city
        state pincode country customer_type loyalty_tier preferred_language
        preferred_device preferred_payment_method preferred_category secondary_category
        email phone_number referral_source campaign_source device_os app_version""",
)

ORDERS = _schema(
    order="""order_id customer_id order_date order_time product_id product_name brand
        category sub_category quantity unit_price order_value discount_amount coupon_code
        payment_type payment_status order_status delivery_partner warehouse_id
        shipping_city shipping_state shipping_pincode delivery_time_days is_returned
        return_reason refund_amount is_cancelled cancellation_reason cod_flag
        customer_rating inventory_available_flag stock_level_at_order high_rto_risk_flag
        fraud_flag order_source traffic_source campaign_id margin profit""",
    bigint="order_id customer_id",
    int="quantity delivery_time_days customer_rating stock_level_at_order",
    double="unit_price order_value discount_amount refund_amount margin profit",
    date="order_date",
    boolean="""is_returned is_cancelled cod_flag inventory_available_flag
        high_rto_risk_flag fraud_flag""",
    string="""order_time product_id product_name brand category sub_category coupon_code
        payment_type payment_status order_status delivery_partner warehouse_id
        shipping_city shipping_state shipping_pincode return_reason cancellation_reason
        order_source traffic_source campaign_id""",
)

MARKETING = _schema(
    order="""interaction_id customer_id order_id campaign_id campaign_name campaign_type
        channel message_id send_timestamp delivery_status open_flag click_flag
        conversion_flag conversion_order_id conversion_value time_to_open_seconds
        time_to_click_seconds device_type platform customer_segment customer_risk_segment
        personalization_flag recommended_product recommended_category engagement_score
        propensity_to_buy_score unsubscribe_flag spam_flag fatigue_score
        frequency_last_7_days frequency_last_30_days best_send_time_hour ab_test_group
        geo_city geo_state response_type marketing_cost revenue_generated roi""",
    bigint="interaction_id customer_id order_id conversion_order_id",
    int="""time_to_open_seconds time_to_click_seconds frequency_last_7_days
        frequency_last_30_days best_send_time_hour""",
    double="""conversion_value engagement_score propensity_to_buy_score fatigue_score
        marketing_cost revenue_generated roi""",
    timestamp_ntz="send_timestamp",
    boolean="""open_flag click_flag conversion_flag personalization_flag unsubscribe_flag
        spam_flag""",
    string="""campaign_id campaign_name campaign_type channel message_id delivery_status
        device_type platform customer_segment customer_risk_segment recommended_product
        recommended_category ab_test_group geo_city geo_state response_type""",
)

SELLERS = _schema(
    order="""seller_id seller_name seller_type seller_category seller_tier seller_city
        seller_state seller_pincode seller_country seller_onboard_date years_on_platform
        total_products_listed active_products total_orders total_revenue avg_order_value
        monthly_sales growth_rate_pct unique_customers_served repeat_customer_pct
        avg_customer_rating customer_lifetime_value_avg return_rate_pct
        cancellation_rate_pct rto_rate_pct fraud_flag_rate avg_delivery_days
        late_delivery_pct fulfillment_type top_delivery_partner stock_out_rate
        inventory_turnover_ratio avg_stock_level marketing_spend marketing_roi
        conversion_rate_pct click_through_rate_pct avg_discount_pct
        price_competitiveness_score campaigns_run email_engagement_rate
        whatsapp_engagement_rate high_value_customer_pct discount_hunter_pct cod_users_pct
        high_risk_customer_pct seller_score seller_risk_score seller_growth_score
        is_top_seller is_high_return_seller is_high_risk_seller""",
    bigint="seller_id",
    int="""years_on_platform total_products_listed active_products total_orders
        unique_customers_served avg_stock_level campaigns_run""",
    double="""total_revenue avg_order_value monthly_sales growth_rate_pct
        repeat_customer_pct avg_customer_rating customer_lifetime_value_avg
        return_rate_pct cancellation_rate_pct rto_rate_pct fraud_flag_rate
        avg_delivery_days late_delivery_pct stock_out_rate inventory_turnover_ratio
        marketing_spend marketing_roi conversion_rate_pct click_through_rate_pct
        avg_discount_pct price_competitiveness_score email_engagement_rate
        whatsapp_engagement_rate high_value_customer_pct discount_hunter_pct cod_users_pct
        high_risk_customer_pct seller_score seller_risk_score seller_growth_score""",
    date="seller_onboard_date",
    boolean="is_top_seller is_high_return_seller is_high_risk_seller",
    string="""seller_name seller_type seller_category seller_tier seller_city seller_state
        seller_pincode seller_country fulfillment_type top_delivery_partner""",
)

MAPPING = _columns(
    "customer_id bigint, order_id bigint, product_id string, category string, seller_id bigint"
)

ORDER_EVENTS = _columns(
    "event_id bigint, event_timestamp timestamp_ntz, customer_id bigint, seller_id bigint, "
    "order_value double, category string, payment_type string, is_returned boolean, "
    "is_cancelled boolean, customer_rating int, delivery_time_days int"
)

EVENT_LEDGER = _columns("event_id bigint")
MERGED_IDS = _columns("last_id bigint")

# Raw event files as delivered.
RAW_EVENTS = _columns(
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)

BASE_TABLES = {
    "customers": CUSTOMERS,
    "orders": ORDERS,
    "marketing_interactions": MARKETING,
    "sellers": SELLERS,
    "customer_seller_mapping": MAPPING,
    "realtime_order_events": ORDER_EVENTS,
    "realtime_events_merged": EVENT_LEDGER,
}
