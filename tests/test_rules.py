"""Every rule ladder, with rows on both sides of each threshold."""

import pytest
from pyspark.sql import types as T

from souk.functions.ladders import ladder
from souk.plans import enrichment, forecast_customer as fc, forecast_seller as fs
from souk.plans import gold_seller, inventory, overlay, platforms, rfm
from tests.helpers import frame

# name: (rules, default, columns, [(values..., expected), ...])
CASES = {
    "payment": (*enrichment.CUSTOMER_ACTIONS["payment_action"], "cod_pct return_rate_pct", [
        (70.5, 25.5, "BLOCK_COD"), (70.0, 25.5, "LIMIT_COD"), (75.0, 25.0, "LIMIT_COD"),
        (60.0, 30.0, "ENABLE_PREPAID_DISCOUNT"), (61.0, 20.0, "ENABLE_PREPAID_DISCOUNT"),
        (40.0, 90.0, "ALLOW_ALL_PAYMENTS"), (40.1, 0.0, "ENABLE_PREPAID_DISCOUNT"),
        (None, None, "ALLOW_ALL_PAYMENTS"), (80.0, None, "ENABLE_PREPAID_DISCOUNT")]),
    "delivery": (*enrichment.CUSTOMER_ACTIONS["delivery_action"], "avg_delivery_days return_rate_pct", [
        (7.1, 20.1, "USE_FASTEST_COURIER"), (7.0, 50.0, "PRIORITIZE_EXPRESS_SHIPPING"),
        (8.0, 20.0, "PRIORITIZE_EXPRESS_SHIPPING"), (5.0, 50.0, "STANDARD_DELIVERY"),
        (None, 50.0, "STANDARD_DELIVERY")]),
    "inventory": (*enrichment.CUSTOMER_ACTIONS["inventory_action"], "total_orders", [
        (51.0, "PRIORITY_STOCK"), (50.0, "NORMAL"), (0.0, "LOW_PRIORITY"), (1.0, "NORMAL")]),
    "marketing": (*enrichment.CUSTOMER_ACTIONS["marketing_action"],
                  "marketing_roi avg_fatigue_score avg_engagement_score", [
        (-0.1, 0.9, 0.9, "STOP_SPEND"), (0.0, 0.81, 0.9, "COOLDOWN"), (0.0, 0.8, 0.71, "BOOST"),
        (0.0, 0.8, 0.7, "OPTIMIZE"), (None, None, None, "OPTIMIZE"), (None, 0.9, 0.1, "COOLDOWN")]),
    "cx": (*enrichment.CUSTOMER_ACTIONS["cx_action"], "total_cancellations avg_customer_rating", [
        (6.0, 5.0, "PROACTIVE_SUPPORT"), (5.0, 2.9, "FEEDBACK_LOOP"), (5.0, 3.0, "STANDARD"),
        (0.0, None, "STANDARD")]),
    "fraud": (*enrichment.CUSTOMER_ACTIONS["fraud_action"], "fraud_risk_score fraud_flagged_orders", [
        (0.41, 0.0, "REVIEW"), (0.4, 3.0, "BLOCK"), (0.4, 2.0, "MONITOR"), (None, 3.0, "BLOCK")]),
    "lifecycle": (*enrichment.CUSTOMER_ACTIONS["lifecycle_action"], "churn_risk_score total_orders", [
        (0.71, 90.0, "WINBACK"), (0.7, 51.0, "REWARD"), (0.7, 50.0, "ENGAGE")]),
    "tier": (fc.PREDICTED_TIER, "@loyalty_tier", "loyalty_tier clv eng churn", [
        ("bronze", 100001.0, 0.61, 0.0, "silver"), ("bronze", 100000.0, 0.9, 0.0, "bronze"),
        ("bronze", 200000.0, 0.6, 0.0, "bronze"), ("silver", 200001.0, 0.71, 0.0, "gold"),
        ("silver", 200001.0, 0.7, 0.0, "silver"), ("gold", 350001.0, 0.81, 0.0, "platinum"),
        ("gold", 350000.0, 0.9, 0.0, "gold"), ("platinum", 9.0, 0.29, 0.71, "gold"),
        ("platinum", 9.0, 0.3, 0.71, "platinum"), ("gold", 9.0, 0.29, 0.71, "silver"),
        ("gold", 9.0, 0.29, 0.7, "gold"), ("silver", 9.0, 0.1, 0.9, "silver")]),
    "segment": (fc.PREDICTED_SEGMENT, "@segment", "segment d mor f_score m_score", [
        ("Champion", 61.0, 0.0, 1.0, 1.0, "At Risk"), ("Champion", 60.0, 0.0, 1.0, 1.0, "Potential Loyalist"),
        ("Champion", 30.0, 0.0, 1.0, 1.0, "Champion"), ("Champion", None, 0.0, 1.0, 1.0, "Champion"),
        ("Potential Loyalist", 95.0, 3.0, 1.0, 4.0, "Champion"),
        ("Potential Loyalist", 95.0, 2.9, 1.0, 4.0, "At Risk"),
        ("Potential Loyalist", 95.0, 3.0, 1.0, 3.0, "At Risk"),
        ("Potential Loyalist", 90.0, 2.9, 1.0, 4.0, "Potential Loyalist"),
        ("New Customer", 99.0, 0.0, 3.0, 3.0, "Potential Loyalist"),
        ("New Customer", 61.0, 0.0, 2.0, 3.0, "At Risk"), ("New Customer", 60.0, 0.0, 2.0, 5.0, "New Customer"),
        ("At Risk", 121.0, 0.0, 1.0, 1.0, "At Risk"), ("Cant Lose Them", 500.0, 9.0, 5.0, 5.0, "Cant Lose Them"),
        (None, 500.0, 9.0, 5.0, 5.0, None)]),
    "churn": (fc.CHURN_30D, "LOW", "churn d eng", [
        (0.71, 61.0, 0.29, "VERY HIGH"), (0.71, 60.0, 0.29, "HIGH"), (0.71, 61.0, 0.3, "HIGH"),
        (0.7, 46.0, 0.39, "HIGH"), (0.7, 45.0, 0.39, "MEDIUM"), (0.7, 46.0, 0.4, "MEDIUM"),
        (0.41, 0.0, 0.9, "MEDIUM"), (0.4, 31.0, 0.9, "MEDIUM"), (0.4, 30.0, 0.9, "LOW"),
        (0.4, None, 0.1, "LOW"), (None, 31.0, 0.9, "MEDIUM"), (None, None, None, "LOW")]),
    "priority": (fc.RETENTION_PRIORITY, "LOW", "exposed churn clv", [
        (100001.0, 0.1, 1.0, "CRITICAL"), (100000.0, 0.71, 50001.0, "HIGH"),
        (1.0, 0.71, 50000.0, "MEDIUM"), (1.0, 0.51, 9.0, "MEDIUM"), (1.0, 0.5, 9.0, "LOW")]),
    "stability": (fc.PERSONA_STABILITY, "MONITOR", "eng disc churn", [
        (0.71, 0.29, 0.9, "STABLE"), (0.7, 0.29, 0.9, "LIKELY STABLE"), (0.71, 0.3, 0.9, "LIKELY STABLE"),
        (0.51, 0.49, 0.9, "LIKELY STABLE"), (0.5, 0.4, 0.61, "LIKELY SHIFTING"),
        (0.29, 0.9, 0.6, "LIKELY SHIFTING"), (0.3, 0.9, 0.6, "MONITOR"), (0.6, 0.5, 0.6, "MONITOR")]),
    "intervention": (fc.INTERVENTION, fc.INTERVENTION_OTHER, "exposed churn d eng upsell", [
        (100001.0, 0.9, 99.0, 0.1, 0.9, "IMMEDIATE_WINBACK_CAMPAIGN"),
        (9.0, 0.71, 61.0, 0.29, 0.9, "PERSONALIZED_RETENTION_OFFER"),
        (9.0, 0.71, 60.0, 0.29, 0.9, "LOYALTY_BONUS_ACTIVATION"),
        (9.0, 0.7, 99.0, 0.1, 0.61, "UPSELL_CROSS_SELL_CAMPAIGN"),
        (9.0, 0.61, 99.0, 0.9, 0.6, "ENGAGEMENT_REACTIVATION"),
        (9.0, 0.6, 99.0, 0.29, 0.6, "ENGAGEMENT_REACTIVATION"),
        (9.0, 0.6, 99.0, 0.3, 0.6, "STANDARD_ENGAGEMENT")]),
    "intervention_v2": (fc.INTERVENTION_V2, fc.INTERVENTION_OTHER,
        "retention_priority churn_prediction_30d upsell_potential_score persona_stability "
        "predicted_rfm_segment current_rfm_segment", [
        ("CRITICAL", "VERY HIGH", 0.9, "LIKELY SHIFTING", "a", "b", "IMMEDIATE_WINBACK_CAMPAIGN"),
        ("HIGH", "VERY HIGH", 0.9, "LIKELY SHIFTING", "a", "b", "PERSONALIZED_RETENTION_OFFER"),
        ("HIGH", "HIGH", 0.9, "LIKELY SHIFTING", "a", "b", "LOYALTY_BONUS_ACTIVATION"),
        ("HIGH", "MEDIUM", 0.61, "LIKELY SHIFTING", "a", "b", "UPSELL_CROSS_SELL_CAMPAIGN"),
        ("HIGH", "MEDIUM", 0.6, "LIKELY SHIFTING", "a", "b", "ENGAGEMENT_REACTIVATION"),
        ("HIGH", "MEDIUM", 0.6, "STABLE", "a", "b", "SEGMENT_TRANSITION_NURTURE"),
        ("HIGH", "MEDIUM", 0.6, "STABLE", "a", "a", "STANDARD_ENGAGEMENT"),
        ("HIGH", "MEDIUM", 0.6, "STABLE", None, "a", "STANDARD_ENGAGEMENT")]),
    "seller_tier": (fs.PREDICTED_TIER, "@seller_tier", "seller_tier score gscore risk g", [
        ("bronze", 60.0, 50.0, 0.0, 0.0, "silver"), ("bronze", 59.9, 50.0, 0.0, 0.0, "bronze"),
        ("silver", 75.0, 65.0, 99.0, -99.0, "gold"), ("silver", 75.0, 64.9, 80.0, 0.0, "bronze"),
        ("silver", 0.0, 0.0, 79.9, -20.0, "silver"), ("silver", 0.0, 0.0, 0.0, -20.1, "bronze"),
        ("gold", 90.0, 80.0, 99.0, -99.0, "platinum"), ("gold", 0.0, 0.0, 70.0, 0.0, "silver"),
        ("gold", 0.0, 0.0, 69.9, -15.0, "gold"), ("gold", 0.0, 0.0, 0.0, -15.1, "silver"),
        ("platinum", 0.0, 0.0, 60.0, 0.0, "gold"), ("platinum", 0.0, 0.0, 59.9, -10.0, "platinum"),
        ("platinum", 0.0, 0.0, 0.0, -10.1, "gold"), ("platinum", 0.0, 0.0, 0.0, None, "platinum")]),
    "trend": (fs.GROWTH_TREND, "DECLINING", "g", [
        (30.0, "ACCELERATING"), (29.9, "GROWING"), (10.0, "GROWING"), (9.9, "STABLE"), (0.0, "STABLE"),
        (-0.1, "SLOWING"), (-10.0, "SLOWING"), (-10.1, "DECLINING"), (None, "DECLINING")]),
    "risk": (fs.RISK_FORECAST, "STABLE", "risk rr fraud", [
        (70.0, 20.1, 0.0, "CRITICAL"), (70.0, 20.0, 0.0, "HIGH"), (60.0, 0.0, 0.0, "HIGH"),
        (0.0, 15.1, 0.0, "HIGH"), (0.0, 0.0, 5.1, "HIGH"), (59.9, 15.0, 5.0, "ELEVATED"),
        (40.0, 0.0, 0.0, "ELEVATED"), (0.0, 10.1, 0.0, "ELEVATED"), (39.9, 10.0, 5.0, "STABLE"),
        (39.0, None, None, "STABLE")]),
    "base": (fs.CUSTOMER_BASE, "DECLINING", "g repeat", [
        (20.1, 40.1, "STRONG GROWTH"), (20.0, 40.1, "MODERATE GROWTH"), (20.1, 40.0, "MODERATE GROWTH"),
        (10.0, 99.0, "STABLE"), (10.1, 30.0, "STABLE"), (0.0, 50.1, "RETAINED BUT SHRINKING"),
        (0.0, 50.0, "DECLINING")]),
    "ops": (fs.OPS_FORECAST, "HEALTHY", "late days", [
        (30.1, 0.0, "DETERIORATING"), (30.0, 8.1, "DETERIORATING"), (15.1, 8.0, "AT RISK"),
        (15.0, 6.1, "AT RISK"), (15.0, 6.0, "ACCEPTABLE"), (5.1, 6.0, "ACCEPTABLE"), (5.0, 6.0, "HEALTHY")]),
    "profit": (fs.PROFIT_TRAJECTORY, "LOSS MAKING", "margin disc", [
        (15.1, 9.9, "STRONG & SUSTAINABLE"), (15.1, 10.0, "HEALTHY"), (10.1, 30.0, "HEALTHY"),
        (10.0, 20.1, "DISCOUNT DEPENDENT"), (10.0, 20.0, "THIN MARGINS"), (5.0, 30.0, "THIN MARGINS"),
        (0.0, 0.0, "LOSS MAKING"), (None, 0.0, "LOSS MAKING")]),
    "performance": (fs.PREDICTED_PERFORMANCE, "@performance", "performance score risk g", [
        ("Top Performer", 90.0, 0.0, -10.1, "Good Performer"), ("Top Performer", 90.0, 0.0, -10.0, "Top Performer"),
        ("Good Performer", 80.0, 0.0, 15.1, "Top Performer"), ("Good Performer", 79.9, 0.0, 15.1, "Good Performer"),
        ("Good Performer", 90.0, 0.0, -15.1, "Average Performer"),
        ("Average Performer", 65.0, 99.0, 20.1, "Good Performer"),
        ("Average Performer", 65.0, 70.0, 20.0, "Needs Improvement"),
        ("Average Performer", 65.0, 69.9, 20.0, "Average Performer"),
        ("Needs Improvement", 99.0, 0.0, 99.0, "Needs Improvement")]),
    "invest": (fs.INVESTMENT, "MONITOR", "flagged risk score g", [
        (True, 99.0, 99.0, -0.1, "DIVEST"), (True, 70.0, 99.0, 0.0, "RESTRICT"),
        (False, 69.9, 80.0, 20.0, "INVEST HEAVILY"), (False, 0.0, 79.9, 20.0, "INVEST MODERATELY"),
        (False, 0.0, 60.0, 9.9, "MAINTAIN"), (False, 0.0, 60.0, -0.1, "MONITOR"),
        (False, 0.0, 59.9, -10.1, "REDUCE EXPOSURE"), (False, 0.0, 59.9, 50.0, "MONITOR"),
        (None, 0.0, 10.0, -1.0, "MONITOR")]),
    "action": (fs.RECOMMENDED_ACTION, "STANDARD_MONITORING", "flagged rr risk late g roi score margin disc", [
        (True, 20.1, 99.0, 0.0, 0.0, 0.0, 0.0, 9.0, 0.0, "IMMEDIATE_QUALITY_AUDIT"),
        (True, 20.0, 70.0, 0.0, 0.0, 0.0, 0.0, 9.0, 0.0, "RISK_MITIGATION_PLAN"),
        (False, 99.0, 69.9, 30.1, 0.0, 0.0, 0.0, 9.0, 0.0, "LOGISTICS_OVERHAUL"),
        (False, 0.0, 0.0, 30.0, -15.1, -1.0, 0.0, 9.0, 0.0, "GROWTH_RECOVERY_PROGRAM"),
        (False, 0.0, 0.0, 0.0, -15.0, -0.1, 0.0, 9.0, 0.0, "MARKETING_OPTIMIZATION"),
        (False, 0.0, 0.0, 0.0, 20.0, None, 80.0, 9.0, 0.0, "SCALE_UP_SUPPORT"),
        (False, 0.0, 0.0, 0.0, 19.9, 0.0, 80.0, 4.9, 20.1, "PRICING_STRATEGY_REVIEW"),
        (False, 0.0, 0.0, 0.0, 19.9, 0.0, 80.0, 5.0, 20.1, "STANDARD_MONITORING")]),
    "final_action": (enrichment.FINAL_ACTION, enrichment.FINAL_ACTION_OTHER,
        "risk_segment actual_return_rate_pct late_delivery_pct marketing_roi growth_segment performance_segment", [
        ("High Risk", 99.0, 99.0, -1.0, "High Growth", "Top Performer", "RESTRICT_SELLER"),
        ("Low Risk", 25.1, 99.0, -1.0, "High Growth", "Top Performer", "FIX_PRODUCT_QUALITY"),
        ("Low Risk", 25.0, 20.1, -1.0, "High Growth", "Top Performer", "CHANGE_LOGISTICS"),
        ("Low Risk", 25.0, 20.0, -0.1, "High Growth", "Top Performer", "STOP_MARKETING"),
        ("Low Risk", 25.0, 20.0, 0.0, "High Growth", "Top Performer", "BOOST_SELLER"),
        ("Low Risk", None, 20.0, None, "Stable", "Top Performer", "PRIORITIZE_SELLER"),
        ("Low Risk", None, 20.0, None, "Stable", "Good Performer", "OPTIMIZE")]),
    "risk_segment": (*gold_seller.SEGMENTS["risk_segment"], "seller_risk_score is_high_risk_seller", [
        (70.0, False, "High Risk"), (0.0, True, "High Risk"), (69.9, False, "Medium Risk"),
        (40.0, None, "Medium Risk"), (39.9, False, "Low Risk"), (None, True, "High Risk")]),
    "performance_segment": (*gold_seller.SEGMENTS["performance_segment"], "seller_score is_top_seller", [
        (80.0, True, "Top Performer"), (80.0, False, "Good Performer"), (79.9, True, "Good Performer"),
        (59.9, True, "Average Performer"), (40.0, False, "Average Performer"), (39.9, True, "Needs Improvement")]),
    "growth_segment": (*gold_seller.SEGMENTS["growth_segment"], "growth_rate_pct", [
        (30.0, "High Growth"), (29.9, "Moderate Growth"), (10.0, "Moderate Growth"), (9.9, "Stable"),
        (0.0, "Stable"), (-0.1, "Declining"), (None, "Declining")]),
    "live_churn": (overlay.REALTIME_CHURN, "LOW", "s0 s6 s1", [
        (0.9, 0.9, 0.71, "VERY HIGH"), (0.9, 0.9, 0.7, "HIGH"), (0.9, 0.5, 0.5, "MEDIUM"),
        (0.31, 0.1, 0.1, "MEDIUM"), (0.3, 0.3, 0.3, "LOW"), (None, None, None, "LOW")]),
    "change_churn": (overlay.CHURN_FOR_CHANGE, "LOW", "s0 s6 s1", [
        (0.9, 0.71, 0.6, "VERY HIGH"), (0.9, 0.7, 0.6, "HIGH"), (0.9, 0.5, 0.4, "MEDIUM")]),
    "live_priority": (overlay.REALTIME_PRIORITY, "LOW", "live_exposed s0 live_clv", [
        (100001.0, 0.1, 1.0, "CRITICAL"), (100000.0, 0.71, 50001.0, "HIGH"), (1.0, 0.71, 50000.0, "MEDIUM"),
        (1.0, 0.5, 99.0, "LOW")]),
    "live_risk": (overlay.REALTIME_RISK, "STABLE", "x x4", [
        (0.8, 0.71, "CRITICAL"), (0.8, 0.7, "HIGH"), (0.5, 0.5, "ELEVATED"), (0.3, 0.3, "STABLE")]),
    "rfm": ([*rfm.RFM_SEGMENT, *rfm.RFM_DEFAULT], rfm.RFM_OTHER, "r_score f_score m_score", [
        (4.0, 4.0, 4.0, "Champion"), (5.0, 3.0, 3.0, "Potential Loyalist"), (4.0, 2.0, 5.0, "New Customer"),
        (1.0, 4.0, 4.0, "Cant Lose Them"), (2.0, 4.0, 4.0, "At Risk"), (1.0, 1.0, 1.0, "At Risk"),
        (3.0, 3.0, 3.0, "Potential Loyalist")]),
    "stock": (inventory.RISK_LEVEL, "HEALTHY", "stock_after_pending", [
        (0.0, "STOCKOUT"), (-4.0, "STOCKOUT"), (1.0, "CRITICAL"), (3.0, "CRITICAL"), (4.0, "WARNING"),
        (10.0, "WARNING"), (11.0, "HEALTHY")]),
    "platforms": (platforms.SEGMENT, "SINGLE_PLATFORM", "platform_count", [
        (1.0, "SINGLE_PLATFORM"), (2.0, "DUAL_PLATFORM"), (3.0, "MULTI_PLATFORM"),
        (4.0, "OMNICHANNEL_POWER_USER"), (7.0, "OMNICHANNEL_POWER_USER")]),
}


@pytest.mark.parametrize("name", list(CASES))
def test_ladder(spark, name):
    rules, default, columns, cases = CASES[name]
    names = columns.split()
    rows = [dict(zip(names, case[:-1])) | {"id": i} for i, case in enumerate(cases)]
    empty = {n: T.DoubleType() for n in names if all(r[n] is None for r in rows)}
    df = frame(spark, rows, **empty).select("id", ladder(rules, default).alias("got"))
    got = {r.id: r.got for r in df.collect()}
    assert [got[i] for i in range(len(cases))] == [case[-1] for case in cases]
