import datetime as dt

import pytest

from souk.plans import enrichment, forecast_customer, forecast_seller, gold_customer, gold_seller, rfm
from souk.sources import schemas
from tests.helpers import as_set, by, typed

NOW = "2024-01-31 00:00:00"
AS_OF = "2001-08-02"
D = dt.date


def order(i, customer, day, value, **more):
    base = dict(
        order_id=i, customer_id=customer, order_date=day, order_time="10:00:00", order_value=value,
        discount_amount=1.0, quantity=2, category="A", brand="b1", product_id="p1", product_name="n",
        payment_type="COD", payment_status="completed", order_status="delivered", delivery_time_days=4,
        is_returned=False, is_cancelled=False, refund_amount=0.0, cod_flag=True, customer_rating=5,
        stock_level_at_order=20, high_rto_risk_flag=False, fraud_flag=False, order_source="website",
        traffic_source="email", margin=value / 10, profit=value / 20,
    )
    return base | more


ORDERS = [
    order(1, 1, D(2001, 7, 1), 100.10),
    order(2, 1, D(2001, 7, 31), 50.20, category="B", brand="b2", payment_type="Credit Card",
          cod_flag=False, is_returned=True, refund_amount=45.18, customer_rating=None,
          order_status="returned", order_source="marketplace"),
    order(3, 1, D(2001, 7, 31), 49.70, category="B", brand="b1", payment_type="UPI", cod_flag=False,
          is_cancelled=True, customer_rating=None, order_status="Cancelled", fraud_flag=True),
    order(4, 2, D(2001, 6, 1), 10.0, order_status="Delivered", category=None, brand=None),
]
CUSTOMERS = [
    dict(customer_id=i, first_name="F", last_name=f"L{i}", city="c", state="s", pincode="p",
         loyalty_tier=t, churn_risk_score=ch, engagement_score=en, customer_lifetime_value=clv,
         discount_sensitivity_score=0.2, price_sensitivity_score=0.3, return_behavior_score=0.1,
         fraud_risk_score=0.1, total_orders=9)
    for i, t, ch, en, clv in [
        (1, "Platinum", 0.9, 0.2, 120000.0), (2, "gold", 0.5, 0.5, 0.0), (3, "bronze", None, 0.9, 5000.0)]
]
MARKETING = [
    dict(interaction_id=i, customer_id=1, campaign_id=c, channel=ch, delivery_status=ds, open_flag=o,
         click_flag=k, conversion_flag=v, conversion_value=val, marketing_cost=2.0,
         revenue_generated=val, device_type="web", engagement_score=0.5, fatigue_score=0.25,
         propensity_to_buy_score=0.5, best_send_time_hour=h, customer_segment=seg,
         customer_risk_segment="low_risk", unsubscribe_flag=False, spam_flag=False)
    for i, c, ch, ds, o, k, v, val, h, seg in [
        (1, "X", "sms", "delivered", True, True, True, 10.0, 9, "new"),
        (2, "X", "sms", "delivered", True, False, False, 0.0, 10, "dormant"),
        (3, "Y", "email", "failed", False, False, False, 0.0, 9, "churned")]
]
SELLERS = [
    dict(seller_id=i, seller_name=f"S{i}", seller_tier="gold", seller_score=score, seller_risk_score=30.0,
         seller_growth_score=50.0, growth_rate_pct=g, is_top_seller=top, is_high_risk_seller=False,
         total_products_listed=listed, active_products=listed // 2, marketing_roi=roi, monthly_sales=ms,
         late_delivery_pct=10.0, avg_discount_pct=5.0, repeat_customer_pct=40.0,
         seller_onboard_date=D(2001, 7, 2))
    for i, score, g, top, listed, roi, ms in [
        (0, 85.0, 30.0, True, 10, None, 1000.0), (1, 50.0, -10.0, False, 0, 4.0, 0.0),
        (2, 10.0, -30.0, False, 4, -0.5, 0.0)]
]
MAPPING = [dict(customer_id=o["customer_id"], order_id=o["order_id"], product_id="p1",
                category=o["category"], seller_id=o["order_id"] % 2) for o in ORDERS]


@pytest.fixture(scope="module")
def t(spark):
    data = {"orders": ORDERS, "customers": CUSTOMERS, "marketing_interactions": MARKETING,
            "sellers": SELLERS, "customer_seller_mapping": MAPPING}
    return {n: typed(spark, schemas.BASE_TABLES[n], rows) for n, rows in data.items()}


@pytest.fixture(scope="module")
def gold(t):
    facts = gold_customer.customer_order_facts(t["orders"])
    touch = gold_customer.customer_marketing_facts(t["marketing_interactions"])
    return gold_customer.gold_customer_360(t["customers"], facts, touch, NOW).cache()


@pytest.fixture(scope="module")
def sold(t):
    return gold_seller.seller_orders(t["orders"], t["customer_seller_mapping"]).cache()


@pytest.fixture(scope="module")
def gold_sellers(t, sold):
    return gold_seller.gold_seller_360(
        t["sellers"], gold_seller.seller_order_metrics(sold),
        gold_seller.seller_customer_metrics(t["customers"], t["customer_seller_mapping"]),
        gold_seller.seller_top_values(sold), AS_OF, NOW).cache()


def test_gold_customer_columns_and_rows(gold):
    assert len(gold.columns) == 120 and gold.count() == 3


def test_customer_with_orders(gold):
    r = by(gold, "customer_id")[1]
    assert (r.total_orders, r.unique_orders, r.total_order_value) == (3, 3, 200.0)
    assert r.avg_order_value == pytest.approx(200 / 3) and r.max_order_value == 100.10
    assert (r.first_order_date, r.last_order_date, r.order_span_days) == (D(2001, 7, 1), D(2001, 7, 31), 30)
    assert (r.total_items_purchased, r.avg_items_per_order) == (6, 2.0)
    assert (r.unique_categories_purchased, r.unique_brands_purchased) == (2, 2)
    assert (r.total_returns, r.return_rate_pct, r.cancellation_rate_pct) == (1, 33.33, 33.33)
    assert (r.cod_orders, r.upi_orders, r.card_orders, r.cod_pct) == (1, 1, 0, 33.33)
    assert (r.delivered_orders, r.avg_customer_rating, r.fraud_flagged_orders) == (1, 5.0, 1)
    assert (r.most_frequent_category, r.most_frequent_brand) == ("B", "b1")
    assert r.preferred_order_source == "website" and r.preferred_payment_type == "COD"
    assert (r.total_marketing_interactions, r.unique_campaigns_received) == (3, 2)
    assert (r.open_rate_pct, r.click_rate_pct, r.conversion_rate_pct) == (100.0, 50.0, 100.0)
    assert (r.marketing_roi, r.preferred_channel, r.best_send_time_hour) == (1.67, "sms", 9)
    assert (r.latest_customer_segment, r.avg_time_to_open_seconds) == ("new", None)
    assert (r.combined_revenue, r.has_ordered, r.has_marketing_engagement) == (210.0, True, True)


def test_customer_without_orders_or_marketing(gold):
    r = by(gold, "customer_id")[3]
    assert (r.total_orders, r.total_order_value, r.card_orders, r.unique_orders) == (0, 0.0, 0, 0)
    assert (r.avg_order_value, r.last_order_date, r.return_rate_pct, r.cod_pct) == (None,) * 4
    assert (r.most_frequent_category, r.total_marketing_interactions, r.marketing_roi) == (None, 0, None)
    assert (r.has_ordered, r.has_marketing_engagement, r.combined_revenue) == (False, False, 0.0)


def test_label_case_and_missing_values(gold):
    r = by(gold, "customer_id")[2]
    assert (r.delivered_orders, r.unique_categories_purchased, r.most_frequent_category) == (1, 0, None)
    assert r.order_span_days == 0


def test_seller_measures(sold, gold_sellers):
    rows = by(gold_sellers, "seller_id")
    assert len(gold_sellers.columns) == 109 and len(rows) == 3
    one, two = rows[1], rows[2]
    assert (one.total_orders_actual, one.total_order_value, one.unique_customers) == (2, 149.8, 1)
    assert one.profit_margin_pct == 5.0 and one.avg_margin_pct == 7.49
    assert (one.fraud_flagged_orders, one.fraud_rate_pct) == (1, 50.0)
    assert (two.total_orders_actual, two.fraud_rate_pct, two.most_sold_category) == (None, None, None)
    zero = rows[0]
    assert (zero.card_orders, zero.delivered_orders) == (1, 1)
    assert zero.unique_categories_sold == 1 and zero.most_sold_category == "B"
    assert (zero.product_active_pct, one.product_active_pct) == (50.0, None)
    assert zero.seller_tenure_days == 31
    assert [rows[i].performance_segment for i in range(3)] == [
        "Top Performer", "Average Performer", "Needs Improvement"]


def test_a_missing_category_can_be_the_top_one(spark):
    rows = [order(1, 1, D(2001, 1, 1), 1.0, category=None), order(2, 1, D(2001, 1, 1), 1.0, category=None),
            order(3, 1, D(2001, 1, 1), 1.0)]
    sold = gold_seller.seller_orders(
        typed(spark, schemas.ORDERS, rows),
        typed(spark, schemas.MAPPING, [dict(order_id=i, seller_id=9) for i in (1, 2, 3)]))
    assert gold_seller.seller_top_values(sold).first().most_sold_category is None


def test_customer_mix_is_weighted_by_orders(t):
    weighted = by(gold_seller.seller_customer_metrics(t["customers"], t["customer_seller_mapping"]), "seller_id")
    once = by(gold_seller.seller_customer_metrics(
        t["customers"], t["customer_seller_mapping"], per_customer=True), "seller_id")
    assert (weighted[1].total_customers_served, weighted[1].platinum_customers) == (1, 2)
    assert weighted[1].high_value_customer_pct_actual == 200.0
    assert once[1].high_value_customer_pct_actual == 100.0
    assert weighted[0].avg_customer_clv == 60000.0 and weighted[0].gold_customers == 1


def test_order_fact(t):
    fact = gold_seller.order_fact(
        t["orders"], t["customers"], t["customer_seller_mapping"], t["sellers"])
    assert len(fact.columns) == 68 and fact.count() == 4
    r = by(fact, "order_id")[2]
    assert (r.customer_name, r.seller_name, r.order_rating) == ("F L1", "S0", None)


def test_mapping_uses_turns_and_known_customers(spark, t):
    from pyspark.sql import functions as F

    orders = t["orders"].unionByName(typed(spark, schemas.ORDERS, [order(9, 77, D(2001, 1, 1), 1.0)]))
    got = gold_seller.customer_seller_mapping(orders, t["customers"], F.lit(3), first_seller=1)
    assert as_set(got, "order_id", "seller_id") == [(1, 2), (2, 3), (3, 1), (4, 2)]


def test_rfm_quintiles_and_directions(gold, store):
    base = rfm.rfm_base(gold, AS_OF)
    assert by(base, "customer_id")[1].recency_days == 2 and by(base, "customer_id")[3].recency_days is None
    plain = by(rfm.rfm_scores(base, store), "customer_id")
    turned = by(rfm.rfm_scores(base, store, higher_is_better=True), "customer_id")
    assert [plain[i].r_score for i in (1, 2, 3)] == [5, 4, 3]
    assert [plain[i].f_score for i in (1, 2, 3)] == [1, 2, 3]
    for i in (1, 2, 3):
        assert turned[i].f_score == 6 - plain[i].f_score and turned[i].r_score == plain[i].r_score
        assert plain[i].rfm_score == plain[i].r_score + plain[i].f_score + plain[i].m_score


@pytest.fixture(scope="module")
def forecast(spark, gold, tmp_path_factory):
    from souk.sources.store import Store

    store = Store(spark, str(tmp_path_factory.mktemp("rfm")))
    ai = enrichment.customer_ai_360(gold, NOW)
    segments = rfm.rfm_segments(rfm.rfm_scores(rfm.rfm_base(gold, AS_OF), store))
    one = forecast_customer.forecast_customer_outlook(ai, segments, AS_OF, NOW).cache()
    two = forecast_customer.forecast_customer_outlook_v2(ai, segments, AS_OF, NOW).cache()
    return by(one, "customer_id"), by(two, "customer_id")


def test_customer_forecast_by_hand(forecast):
    r = forecast[0][1]
    mor, aov, clv = 3 * 30 / 30, 200 / 3, 120000.0
    p = 0.9 * 0.4 + 2 / 120 * 0.3 + 0.8 * 0.2 + (1 - mor / 5) * 0.1
    up = (1 - aov / 100.10) * 0.4 + 0.2 * 0.3 + 0.2 * 0.3
    assert r.churn_probability_score == round(p, 3) and r.current_monthly_order_rate == 3.0
    assert r.projected_clv_90d == round(clv + mor * aov * 3, 2)
    assert r.clv_growth_pct_90d == round(mor * aov * 3 / clv * 100, 2)
    assert r.predicted_orders_next_30d == 3.0
    assert r.upsell_potential_score == round(up, 3)
    assert r.revenue_at_risk == round(clv * p, 2)
    assert (r.churn_prediction_30d, r.retention_priority) == ("HIGH", "CRITICAL")
    assert r.recommended_intervention == "IMMEDIATE_WINBACK_CAMPAIGN"
    assert r.marketing_responsiveness_score == round(0.15 + 0.2 + 0.1 + 0.2 + 0.075, 3)


def test_customer_without_orders_has_no_score(forecast):
    r = forecast[0][3]
    assert (r.churn_probability_score, r.revenue_at_risk, r.projected_clv_90d) == (None, None, None)
    assert (r.current_monthly_order_rate, r.predicted_orders_next_30d, r.upsell_potential_score) == (0.0, 0.0, 0.0)
    assert (r.churn_prediction_30d, r.retention_priority, r.persona_stability) == ("LOW", "LOW", "STABLE")


def test_no_value_no_growth(forecast):
    assert forecast[0][2].clv_growth_pct_90d == 0.0


def test_second_variant_only_changes_the_intervention(forecast):
    one, two = forecast
    for i in (1, 2, 3):
        a, b = one[i].asDict(), two[i].asDict()
        a.pop("recommended_intervention"), b.pop("recommended_intervention")
        assert a == b


def test_seller_forecast_by_hand(gold_sellers):
    enriched = enrichment.seller_enriched(gold_sellers, NOW)
    rows = by(forecast_seller.forecast_seller_outlook(enriched, NOW), "seller_id")
    a, b, c = rows[0], rows[1], rows[2]
    assert a.projected_revenue_90d == 3900.0
    assert b.projected_revenue_90d == round(149.8 * 0.25 * 0.9, 2)
    assert a.revenue_growth_trend == "ACCELERATING" and b.revenue_growth_trend == "SLOWING"
    e = 0 / 50 * 0.25 + 50 / 30 * 0.2 + 50 / 10 * 0.25 + 30 / 100 * 0.2 + 10 / 20 * 0.1
    assert b.risk_escalation_probability == min(1.0, round(e, 3)) == 1.0
    assert b.revenue_at_risk == 149.8
    health = 100 - max(0, 4 - 3) * 8 - 10 * 1.5 - 50 - 0 * 1.2
    assert a.operational_health_score == round(max(0, min(100, health)), 2)
    assert c.risk_escalation_probability == round(0.06 + 30 / 20 * 0.1, 3)
    assert (c.revenue_at_risk, c.operational_health_score, c.profit_trajectory) == (None, None, "LOSS MAKING")
    # 0.85 * 0.25 + 0.5 * 0.2 + 0.7 * 0.2 + 0.4 * 0.15 + 0.05 * 0.1 = 0.5175, half rounds up
    assert a.sustainability_score == 0.518
    assert c.recommended_action == "GROWTH_RECOVERY_PROGRAM" and c.projected_revenue_90d is None


def test_labels_and_reasons(gold):
    ai = by(enrichment.customer_ai_360(gold, NOW), "customer_id")
    assert ai[1].personalization_action == "RECOMMEND_B" and ai[3].personalization_action == "GENERIC"
    assert ai[1].fraud_reason == "HIGH_RETURN_RATE" and ai[3].fraud_reason == "NONE"
    assert ai[2].persona == "Risky COD Buyer" and ai[2].rto_risk_label == "MEDIUM"
    assert ai[3].settlement_probability == 1.0
    assert ai[1].settlement_probability == round(1 - (0.3333 * 0.4 + 0.3333 * 0.4 + 0.02), 3)
    insights = by(enrichment.identity_insights(gold), "customer_id")
    assert insights[1].fraud_risk_label == "MEDIUM"


def test_seller_context_needs_every_part(gold_sellers):
    rows = by(enrichment.seller_enriched(gold_sellers, NOW), "seller_id")
    assert rows[0].seller_context is None and rows[2].seller_context is None
    assert rows[1].seller_context == (
        "Seller Summary: Revenue=149.80, Orders=2, ReturnRate=0.00, COD=50.00, Growth=-10.00, "
        "ROI=4.00, Category=A, Rating=5.00")


def test_embeddings_are_unit_vectors_and_alike_for_alike_sellers(gold_sellers):
    vectors = by(enrichment.embedding_arrays(enrichment.seller_embeddings(gold_sellers)), "seller_id")
    for r in vectors.values():
        assert len(r.seller_embedding) == 1024
        assert sum(x * x for x in r.seller_embedding) == pytest.approx(1.0, abs=1e-5)
