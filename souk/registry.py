"""All named queries: inventory id and what it computes, over one engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.engine import REFRESH_ORDER, Engine, engine_for
from souk.functions import hashing, nulls
from souk.functions.exact import exact_avg, exact_sum
from souk.functions.ladders import choose, ladder
from souk.functions.text import quoted_label
from souk.operators import joins, nearest, topk
from souk.operators.profile import Profile, distinct_counts, value_profile
from souk.operators.ranks import Asc, Desc, global_row_number, ntile_columns
from souk.plans import (
    alerts,
    enrichment,
    forecast_customer,
    gold_seller,
    inventory,
    merge,
    reports,
    rfm,
)
from souk.plans.incremental import Incremental, seller_facts, sellers
from souk.sources import paths, schemas
from souk.sources.seller_json import ingest_sellers
from souk.sources.store import Store, conform, with_defaults
from souk.sources.testdata import AS_OF
from souk.sqlviews import ask
from souk.streaming import changes, windows
from souk.streaming.activity import ActivityJobs
from souk.streaming.live import run_live_customers, run_live_sellers
from souk.streaming.reach import reach, run_reach
from souk.streaming.writeback import run_writeback

ONE_CUSTOMER = 7  # the customer shown in the self-service lookups
NAMED_SELLERS = [f"Supplier#{n:09d}" for n in (1, 2, 4, 5, 7, 8, 9)]

Query = Callable[[Engine], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return keep


def add(name: str, fn: Query) -> None:
    QUERIES[name] = fn


def c(name: str):
    return F.col(name)


def portable(df: DataFrame) -> DataFrame:
    """Result in plain types: dates and times as text, whole numbers as bigint."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.substring(col.cast("string"), 1, 19)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            col = col.cast("double")
        out.append(col.alias(f.name))
    return df.select(*out)


def scratch(e: Engine) -> Store:
    """A fresh folder in the engine's shared store, for one run of a job."""
    return Store(e.spark, e.store.path("_runs", uuid.uuid4().hex))


# -- sources and sinks ---------------------------------------------------------



def _typed(e: Engine, name: str) -> DataFrame:
    return conform(e.table(name), schemas.BASE_TABLES[name])


for _t in ("customers", "orders", "marketing_interactions", "sellers", "realtime_order_events"):
    add(f"src01_{_t}", lambda e, t=_t: _typed(e, t))


@query("src02_seller_json_ingest")
def _(e):
    item = F.to_json(F.struct(*[c(n) for n in schemas.SELLERS.fieldNames()]))
    raw = e.table("sellers").select(
        F.explode(
            F.array(
                F.concat(F.lit("["), item, F.lit(", null]")),
                F.lit("[]"),
                F.concat(F.lit("[{ not json "), item),
            )
        ).alias("json_data")
    )
    return ingest_sellers(raw)


@query("src02_json_paths")
def _(e):
    """Sellers as nested objects of unknown shape, with broken texts, mistyped fields and bare objects between them."""
    inner = F.struct(c("seller_tier").alias("tier"), F.array(c("total_orders"), c("active_products")).alias("counts"))
    item = F.to_json(F.struct("seller_id", F.struct("seller_name", inner.alias("shop")).alias("is")))
    odd = F.concat(F.lit('{"seller_id": "'), c("seller_name"), F.lit('", "is": 3}'))
    raw = e.table("sellers").select(F.explode(F.array(
        F.concat(F.lit("["), item, F.lit(", null, "), odd, F.lit("]")), F.concat(F.lit("{ "), item), F.lit("[]"))).alias("body"))
    found = paths.fields(paths.json_items(raw, "body"), seller_id=("$.seller_id", "bigint"), seller_name=("$.is.seller_name", "string"),
                         seller_tier=("$.is.shop.tier", "string"), active_products=("$.is.shop.counts[1]", "bigint"))
    return found.groupBy("seller_id", "seller_name", "seller_tier", "active_products").agg(F.count("*").alias("items"))


@query("src03_replace_table")
def _(e):
    store, people = scratch(e), e.table("customers")
    store.replace("tiers", people.select("customer_id", "loyalty_tier"))
    per_tier = store.read("tiers").groupBy("loyalty_tier").agg(F.count("*").alias("customers"))
    store.replace("tiers", per_tier)
    return store.read("tiers")


@query("src04_append_rows")
def _(e):
    store, events = scratch(e), e.table("realtime_order_events")
    store.append("events", events.filter("is_returned"), 0)
    store.append("events", events.filter("NOT is_returned"), 1)
    store.append("events", events.filter("NOT is_returned"), 1)
    return store.read("events", schemas.ORDER_EVENTS)


@query("src05_create_if_absent")
def _(e):
    store = scratch(e)
    store.create_if_absent("realtime_events_merged", schemas.EVENT_LEDGER)
    store.append("realtime_events_merged", e.table("realtime_order_events").select("event_id"), 0)
    return store.create_if_absent("realtime_events_merged", schemas.EVENT_LEDGER)


def _stream_copy(e, name, **kwargs):
    store = scratch(e)
    e.table("realtime_order_events")
    stream = changes.event_stream(e.spark, e.store.current("realtime_order_events"))
    sink = kwargs.get("sink") or changes.into_table(store, name)
    changes.run(stream, lambda b, n: sink(store, b, n) if kwargs else sink(b, n),
                store.path("_checkpoints", name))
    return store


@query("src06_batch_snapshot")
def _(e):
    def count_batch(store, batch, epoch):
        held = batch.persist()
        store.append("seen", held.select("event_id"), epoch)
        store.append("sizes", held.agg(F.count("*").alias("rows")), epoch)
        held.unpersist()

    store = _stream_copy(e, "snapshot", sink=count_batch)
    return store.read("sizes").agg(F.sum("rows").alias("events"))


add("src07_change_stream", lambda e: _stream_copy(e, "curated").read("curated", schemas.ORDER_EVENTS))


@query("src08_column_defaults")
def _(e):
    bare = e.table("realtime_order_events").withColumns(
        {
            "is_returned": F.when(c("is_returned"), True),
            "is_cancelled": F.when(c("is_cancelled"), True),
        }
    )
    defaults = {"is_returned": F.lit(False), "is_cancelled": F.lit(False),
                "landed_at": F.lit(e.now).cast("timestamp_ntz")}
    return with_defaults(bare, defaults)


add("src09_result_frame", lambda e: e.table("gold_customer_360").agg(
    F.count("*").alias("rows"), F.count_distinct("city").alias("cities")))


@query("src10_add_and_fill_column")
def _(e):
    store = scratch(e)
    segments = store.replace("segments", e.table("rfm_segments").drop("extracted_value"))
    filled = segments.withColumn("extracted_value", quoted_label(c("rfm_segment")))
    return store.replace("segments", filled).select("customer_id", "rfm_segment", "extracted_value")


# -- projections and filters -----------------------------------------------------

add("prj01_rename", lambda e: e.table("customers").select(
    "customer_id", c("city").alias("customer_city"), c("total_orders").alias("profile_total_orders"),
    c("customer_lifetime_value").alias("profile_clv")))
add("prj02_star_plus_columns", lambda e: e.table("sellers").select(
    "*", nulls.pct(c("active_products"), c("total_products_listed")).alias("product_active_pct")))
add("prj03_lateral_alias", lambda e: e.table("gold_customer_360").selectExpr(
    "customer_id", "total_orders * 30D / nullif(order_span_days, 0) AS rate",
    "rate * avg_order_value AS monthly_value", "round(monthly_value * 3, 2) AS quarter_value")
    .select("customer_id", "quarter_value"))
add("prj04_rule_ladder", lambda e: e.table("gold_customer_360").select(
    "customer_id", ladder(*enrichment.CUSTOMER_ACTIONS["payment_action"]).alias("payment_action")))
add("prj05_simple_case", lambda e: e.table("realtime_order_events").select(
    "event_id", choose(hashing.salted_pick(c("event_id"), "brand", 5), merge.BRANDS,
                       merge.BRAND_OTHER).alias("brand")))
add("prj06_inline_conditional", lambda e: e.table("orders").select(
    "order_id", nulls.iff(c("customer_rating") >= 4, "liked", "other").alias("opinion")))
add("prj07_distinct", lambda e: e.table("rfm_segments").select("extracted_value").distinct())
add("prj08_scalar_subqueries", lambda e: reports.live_stats(
    e.table("realtime_order_events"), e.table("orders")))

add("flt01_compare_and_or", lambda e: e.table("inventory_risk").filter(
    (c("risk_level") == "WARNING") & (c("stock_after_pending") < 5) | (c("pending_orders") > 2))
    .select("seller_id", "product_id", "risk_level", "stock_after_pending", "pending_orders"))
add("flt02_in_list", lambda e: e.table("forecast_customer_outlook").filter(
    c("churn_prediction_30d").isin("VERY HIGH", "HIGH")).select("customer_id", "churn_prediction_30d"))
add("flt03_not_in_subquery", lambda e: joins.not_in(
    e.table("customers"), e.table("realtime_order_events"), "customer_id").select("customer_id"))
add("flt04_null_tests", lambda e: e.table("orders").filter(
    c("coupon_code").isNotNull() & c("customer_rating").isNull()).select("order_id", "coupon_code"))
add("flt05_current_vs_predicted", lambda e: e.table("forecast_seller_outlook").filter(
    c("current_seller_tier") != c("predicted_seller_tier"))
    .select("seller_id", "current_seller_tier", "predicted_seller_tier"))
add("flt06_chosen_filter", lambda e: topk.chosen(
    e.table("forecast_customer_outlook"), "retention_priority", "CRITICAL")
    .select("customer_id", "retention_priority"))
add("flt07_point_lookup", lambda e: e.table("orders").filter(c("customer_id") == ONE_CUSTOMER)
    .select("order_id", "customer_id", "order_value"))
add("flt08_boolean_predicate", lambda e: e.table("orders").filter("fraud_flag")
    .select("order_id", "customer_id"))

# -- joins -------------------------------------------------------------------------

add("jn01_inner", lambda e: joins.split_join(
    e.table("orders").select("order_id", "customer_id", "order_value"),
    e.table("customers").select("customer_id", "loyalty_tier"), "customer_id", "order_id"))
add("jn03_left_two_facts", lambda e: e.table("customers").select("customer_id")
    .join(e.table("customer_order_facts"), "customer_id", "left")
    .join(e.table("customer_marketing_facts"), "customer_id", "left")
    .select("customer_id", "total_orders", "total_marketing_interactions"))
add("jn05_left_activity", lambda e: e.table("forecast_customer_outlook")
    .join(e.table("customer_recent_activity"), "customer_id", "left")
    .select("customer_id", "churn_probability_score", "recent_order_count"))


@query("jn06_sample_with_one_seller")
def _(e):
    seller = topk.sample_k(e.table("sellers").select("seller_id"), "seller_id", "s", 1)
    people = topk.sample_k(e.table("customers"), "customer_id", "c", 10)
    return people.select("customer_id", "preferred_category", "preferred_payment_method",
                         seller.scalar().alias("seller_id"))


def _merged(e):
    """Orders made from all live events, as one stored batch."""
    name = "merged_events"
    if name not in e._ready:
        store = e.store
        fresh = merge.unmerged(e.table("realtime_order_events"),
                               e.spark.createDataFrame([], schemas.EVENT_LEDGER))
        numbered = merge.numbered_events(fresh, e.table("customers"), store, "all-events")
        last = merge.max_id(e.table("orders"))
        e._ready[name] = store.replace(name, merge.merged_orders(numbered, last))
    return e._ready[name]


add("jn07_composite_key_mapping", lambda e: merge.mapping_by_value(
    merge.order_rows(_merged(e)), e.table("realtime_order_events"), -1))
add("jn07_one_to_one_mapping", lambda e: merge.mapping_one_to_one(
    merge.order_rows(_merged(e)), e.table("realtime_order_events"), -1, scratch(e)))
add("jn08_left_anti", lambda e: merge.unmerged(
    e.table("realtime_order_events"),
    e.table("realtime_order_events").filter("is_cancelled").select("event_id"))
    .select("event_id", "customer_id"))
add("jn09_flatten_array", lambda e: e.table("cross_platform_identity").select(
    "customer_id", F.explode(F.split("all_platforms", ",")).alias("platform")))
add("jn10_lookup_join", lambda e: reports.customer_loyalty(
    e.table("rfm_segments"), e.table("customers"), ONE_CUSTOMER))

# -- aggregations --------------------------------------------------------------------

add("agg01_by_key", lambda e: e.table("orders").groupBy("brand").agg(
    F.count("*").alias("orders"), exact_sum(c("order_value")).alias("total"),
    exact_avg(c("order_value")).alias("mean"), F.min("order_value").alias("lowest"),
    F.max("order_value").alias("highest")))
add("agg02_many_distinct", lambda e: distinct_counts(e.table("seller_orders"), "seller_id", {
    "orders": "order_id", "customers": "customer_id", "products": "product_id",
    "brands": "brand", "categories": "category"}))
add("agg03_conditional_counts", lambda e: e.table("orders").groupBy("category").agg(
    F.count_if("is_returned").alias("returned"), F.count_if("is_cancelled").alias("cancelled"),
    F.count_if(c("payment_type") == "COD").alias("cod")))
add("agg04_safe_percentage", lambda e: e.table("orders").groupBy("brand", "category").agg(
    nulls.pct(F.count_if("fraud_flag"), F.count_if(c("payment_type") == "COD")).alias("fraud_per_cod")))
add("agg05_mode", lambda e: value_profile(e.table("orders"), "customer_id", Profile(
    modes={"favourite_category": "category", "favourite_brand": "brand"})))
add("agg06_largest_text", lambda e: value_profile(
    e.table("marketing_interactions"), "customer_id",
    Profile(largest={"latest_segment": "customer_segment"})))
add("agg07_date_span", lambda e: e.table("orders").groupBy("customer_id").agg(
    F.date_diff(F.max("order_date"), F.min("order_date")).alias("span_days")))
add("agg08_ratio_of_sums", lambda e: e.table("marketing_interactions").groupBy("channel").agg(
    F.round(exact_sum(c("revenue_generated")) / F.nullif(exact_sum(c("marketing_cost")), F.lit(0.0)), 2)
    .alias("roi")))
add("agg09_global", lambda e: e.table("orders").agg(
    F.count("*").alias("orders"), exact_sum(c("order_value")).alias("total"),
    F.min("order_date").alias("first"), F.max("order_date").alias("last")))
add("agg10_two_keys", lambda e: e.table("orders").groupBy("category", "order_status").agg(
    F.count("*").alias("orders"), exact_sum(c("order_value")).alias("total")))
add("agg11_by_alias", lambda e: e.table("forecast_customer_outlook").withColumn(
    "move", F.concat("current_loyalty_tier", F.lit(">"), "predicted_loyalty_tier"))
    .groupBy("move").agg(F.count("*").alias("customers")))
add("agg12_having", lambda e: e.table("inventory_risk").filter(c("risk_level") == "STOCKOUT")
    .groupBy("seller_id").agg(F.count("*").alias("products")).filter(c("products") >= 3))
add("agg13_ordered_concat", lambda e: alerts.report_text(
    alerts.fraud_details(e.table("sellers")), "fraud_flag_rate", "seller_id",
    ["seller_name", "seller_category"]))
add("agg14_groups_meeting_condition", lambda e: QUERIES["agg12_having"](e).agg(
    F.count("*").alias("sellers")))
add("agg15_highest_id", lambda e: e.table("orders").agg(
    F.coalesce(F.max("order_id"), F.lit(0)).alias("max_order_id")))
add("agg16_conditional_average", lambda e: e.table("orders").groupBy("category").agg(
    exact_avg(F.when(c("customer_rating") >= 4, c("order_value"))).alias("liked_value")))

# -- ranks, sorts, sets ----------------------------------------------------------------


@query("win01_global_ntile")
def _(e):
    base = e.table("gold_customer_360").select("customer_id", "total_order_value", "marketing_roi")
    ranked = {"value_tile": Desc("total_order_value"), "roi_tile": Asc("marketing_roi")}
    tiles = ntile_columns(base, 5, ranked, "customer_id", scratch(e), "tiles")
    return base.withColumns(tiles).select("customer_id", *ranked)


add("win02_top_value_per_group", lambda e: gold_seller.seller_top_values(e.table("seller_orders")))
add("win03_global_row_number", lambda e: global_row_number(
    e.table("realtime_order_events").select("event_id", "event_timestamp"),
    [Asc("event_timestamp"), Asc("event_id")], scratch(e), "rn").select("event_id", "row_number"))
add("win04_numbered_keys", lambda e: global_row_number(
    e.table("sellers").select("seller_id"), [Desc("seller_id")], scratch(e), "rn"))
add("srt01_order_by", lambda e: e.table("sellers").select("seller_id", "seller_score")
    .orderBy(c("seller_score").desc(), "seller_id"))
add("srt02_top_k", lambda e: topk.top_k(
    e.table("orders").select("order_id", "order_value"), "order_value", 20, "order_id"))
add("srt03_preview", lambda e: topk.first_k(
    e.table("gold_customer_360").select("customer_id", "city", "profile_clv"), "customer_id", 10))
add("srt04_random_sample", lambda e: topk.sample_k(
    e.table("customers").select("customer_id", "city"), "customer_id", "sample", 25))

# -- scalar functions --------------------------------------------------------------------

add("fn01_math", lambda e: e.table("orders").select(
    "order_id", F.round(c("order_value") / 3, 2).alias("third"),
    F.abs(c("profit") - c("margin")).alias("gap"), (c("order_id") % 200 + 1).alias("slot"),
    F.pmod(c("order_id") - 1000, F.lit(7)).alias("wrapped")))
add("fn04_null_aware_bounds", lambda e: e.table("sellers").select(
    "seller_id", nulls.greatest_n(0.0, c("marketing_roi")).alias("roi_floor"),
    nulls.least_n(1.0, c("marketing_roi")).alias("roi_cap"),
    nulls.clamp(c("growth_rate_pct"), 0.0, 20.0).alias("growth_clamped"),
    nulls.sign_like(c("marketing_roi")).alias("roi_sign"),
    F.coalesce(F.nullif(c("monthly_sales"), F.lit(0.0)), F.lit(-1.0)).alias("monthly")))
add("fn08_dates", lambda e: e.table("orders").select(
    "order_id", F.date_diff(F.lit(AS_OF).cast("date"), "order_date").alias("age_days"),
    F.date_add("order_date", c("delivery_time_days")).alias("due")))
add("fn09_times", lambda e: e.table("realtime_order_events").select(
    "event_id", F.to_date("event_timestamp").alias("day"),
    merge.clock_time(c("event_timestamp")).alias("time"),
    F.timestamp_diff("SECOND", "event_timestamp", F.lit(e.now).cast("timestamp_ntz")).alias("age_s"),
    (c("event_timestamp") >= F.lit(e.now).cast("timestamp_ntz") - F.expr("INTERVAL 6 HOURS"))
    .alias("within_6h")))
add("fn13_strings", lambda e: e.table("customers").select(
    "customer_id", reports.full_name().alias("name"), F.lower("city").alias("city"),
    F.lpad(c("customer_id").cast("string"), 8, "0").alias("code"),
    F.concat(F.lit("Src="), "campaign_source").alias("source")))
add("fn15_regex_extract", lambda e: e.table("rfm_segments").select(
    "customer_id", quoted_label(c("rfm_segment")).alias("label"),
    quoted_label(F.lit("no quotes")).alias("nothing")))
add("fn17_casts", lambda e: e.table("customers").select(
    "customer_id", c("pincode").try_cast("int").alias("pin"),
    c("app_version").try_cast("int").alias("not_a_number"),
    c("customer_lifetime_value").cast("decimal(18,2)").cast("string").alias("clv_text")))
add("fn18_array_index", lambda e: e.table("realtime_order_events").select(
    "event_id", hashing.pick_from(c("event_id"), "dp", merge.PARTNERS).alias("partner")))
add("fn20_salted_hash", lambda e: e.table("realtime_order_events").select(
    "event_id", hashing.salted_hash(c("event_id"), "qty").alias("h"),
    hashing.salted_pick(c("event_id"), "qty", 5).alias("p")))
add("fn22_null_falls_through", lambda e: e.table("sellers").select(
    "seller_id", ladder([("LOSS", [("marketing_roi", "<", 0)]), ("GAIN", [("marketing_roi", ">=", 0)])],
                        "UNKNOWN").alias("roi_class")))

# -- batch jobs ------------------------------------------------------------------------

for _key, _table in {
    "job01_customer_order_facts": "customer_order_facts",
    "job02_customer_marketing_facts": "customer_marketing_facts",
    "job03_gold_customer_360": "gold_customer_360",
    "job04_order_fact": "order_fact",
    "job08_gold_seller_360": "gold_seller_360",
    "job09_customer_ai_360": "customer_ai_360",
    "job11_rfm_segments": "rfm_segments",
    "job13_forecast_customer_outlook": "forecast_customer_outlook",
    "job15_forecast_seller_outlook": "forecast_seller_outlook",
    "job16_customer_seller_mapping": "customer_seller_mapping",
}.items():
    add(_key, lambda e, t=_table: e.plan(t))


add("job05_seller_order_metrics", lambda e: gold_seller.seller_order_metrics(e.table("seller_orders")))
add("job06_seller_customer_metrics", lambda e: gold_seller.seller_customer_metrics(
    e.table("customers"), e.table("customer_seller_mapping")))
add("job06_seller_customer_metrics_once", lambda e: gold_seller.seller_customer_metrics(
    e.table("customers"), e.table("customer_seller_mapping"), per_customer=True))
add("job07_seller_top_values", lambda e: gold_seller.seller_top_values(e.table("seller_orders")))
add("job10_rfm_scores", lambda e: rfm.rfm_scores(
    rfm.rfm_base(e.table("gold_customer_360"), e.as_of), scratch(e)))
add("job10_rfm_scores_corrected", lambda e: rfm.rfm_scores(
    rfm.rfm_base(e.table("gold_customer_360"), e.as_of), scratch(e), higher_is_better=True))
add("job12_seller_final_action", lambda e: e.plan("seller_enriched").select(
    "seller_id", "seller_context", "final_action"))
add("job14_forecast_customer_outlook_v2", lambda e: forecast_customer.forecast_customer_outlook_v2(
    e.table("customer_ai_360"), e.table("rfm_segments"), e.as_of, e.now))


@query("job17_refresh_all")
def _(e):
    fresh = Engine(e.spark, _Stored(e), scratch(e), e.as_of, e.now)
    built = fresh.refresh()
    parts = [built[n].agg(F.lit(n).alias("mart"), F.count("*").alias("rows")) for n in REFRESH_ORDER]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("job17_refresh_after_writeback")
def _(e):
    """The write-back stream's orders, added twice: the second time none is new."""
    fresh, written = Engine(e.spark, _Stored(e), scratch(e), e.as_of, e.now), _writeback(e)
    made = (written.read("orders_merged", schemas.ORDERS), written.read("mapping_merged", schemas.MAPPING))
    fresh.add_orders(*made)
    built = fresh.absorb(*made)
    people = built["gold_customer_360"].agg(
        F.count("*").alias("customers"), F.sum("total_orders").alias("orders"),
        exact_sum(c("total_order_value")).alias("order_value"),
        F.max("last_order_date").alias("last_order"))
    return people.withColumn(
        "seller_orders", built["gold_seller_360"].agg(F.sum("total_orders_actual")).scalar())


_incremental: dict[Engine, Incremental] = {}


def _absorbed(e) -> Incremental:
    """Marts before the write-back, then its orders as a batch."""
    if e not in _incremental:
        written = _writeback(e)
        orders, mapping = written.read("orders_merged", schemas.ORDERS), written.read("mapping_merged", schemas.MAPPING)
        out = Incremental(scratch(e), e.table("customers"), e.as_of, e.now, buckets=4)
        marts = {n: e.table(n) for n in (*Incremental.MARTS, "rfm_segments")}
        out.start(e.table("orders"), e.seller_links(), marts, e.table("seller_orders"))
        out.absorb(orders, mapping, 1)
        _incremental[e] = out
    return _incremental[e]


add("job17_incremental_refresh", lambda e: _absorbed(e).mart("gold_customer_360"))
for _key, _mart in {
    "job17_incremental_sellers": "gold_seller_360",
    "job17_incremental_scores": "rfm_segments",
    "job17_incremental_customer_forecast": "forecast_customer_outlook",
    "job17_incremental_seller_forecast": "forecast_seller_outlook",
}.items():
    add(_key, lambda e, m=_mart: _absorbed(e).mart(m))


@query("agg02_merged_distincts")
def _(e):
    """Distinct counts of sellers out of the merged states of two halves of their orders."""
    sold, side = e.table("seller_orders"), sellers()
    halves = [side.start(sold.where(f"order_id % 2 = {half}")) for half in (0, 1)]
    out = seller_facts({n: halves[0][n].unionByName(halves[1][n]) for n in halves[0]})
    return out.select("seller_id", "unique_orders", "unique_customers", "unique_products_sold",
                      "unique_categories_sold", "unique_brands_sold")


class _Stored:
    """Base tables of an engine offered as a source for another one."""

    def __init__(self, e: Engine):
        for name in ("customers", "orders", "sellers", "marketing_interactions",
                     "realtime_order_events"):
            setattr(self, name, lambda n=name: e.table(n))
        if hasattr(e.source, "mapped"):
            self.order_rows, self.mapped = e.order_rows, e.source.mapped

    def in_place(self, name: str) -> bool:
        """They are stored already, so the other engine makes no copy."""
        return hasattr(self, name)


# -- labels -------------------------------------------------------------------------------

for _id, _col in {
    "ai01_persona": "persona",
    "ai02_fraud_risk_label": "fraud_risk_label",
    "ai04_settlement_probability": "settlement_probability",
    "ai05_rto_risk_label": "rto_risk_label",
    "ai06_targeting_decision": "targeting_decision",
    "ai12_fraud_reason": "fraud_reason",
    "ai14_marketing_strategy": "marketing_strategy",
}.items():
    add(_id, lambda e, n=_col: e.table("gold_customer_360").select(
        "customer_id", enrichment.customer_labels()[n].alias(n)))
@query("ai01_persona_by_share")
def _(e):
    gold = e.table("gold_customer_360")
    cuts = enrichment.persona_cuts(gold, scratch(e))
    return gold.select("customer_id", enrichment.persona_by_share(cuts).alias("persona"))


add("ai03_rfm_segment_rules", lambda e: rfm.rfm_segments(
    e.table("rfm_segments").select("customer_id", "r_score", "f_score", "m_score", "rfm_score"))
    .select("customer_id", "extracted_value"))
for _id, _cols in {
    "ai07_seller_classification": ["seller_classification"],
    "ai08_performance_sentiment": ["performance_sentiment_score"],
    "ai13_main_risk_and_strength": ["extracted_risk", "extracted_strength"],
    "ai14_seller_suggested_action": ["suggested_action"],
}.items():
    add(_id, lambda e, n=_cols: e.seller_measures().select(
        "seller_id", *[enrichment.seller_labels()[x].alias(x) for x in n]))
add("ai09_seller_embedding", lambda e: enrichment.embedding_arrays(
    enrichment.seller_embeddings(e.table("gold_seller_360"))).select(
        "seller_id", F.size("seller_embedding").alias("dimensions"),
        F.size(F.filter("seller_embedding", lambda x: x != 0)).alias("words"),
        F.round(F.aggregate("seller_embedding", F.lit(0.0), lambda a, x: a + x * x), 3).alias("length")))
def _seller_words(e) -> DataFrame:
    vectors = enrichment.embedding_arrays(enrichment.seller_embeddings(e.table("gold_seller_360")))
    return nearest.entries(vectors, "seller_id", "seller_embedding")


add("ai09_similar_sellers", lambda e: nearest.nearest(_seller_words(e), scratch(e), exact=True).select(
    c("id").alias("seller_id"), "place", c("neighbour").alias("similar_seller"), F.round("similarity", 6).alias("similarity")))


@query("ai09_hashed_neighbours")
def _(e):
    """Hyperplane buckets against all pairs: nine of ten neighbours at least."""
    rows = _seller_words(e)
    exact = nearest.nearest(rows, scratch(e), exact=True)
    found = nearest.recall(nearest.nearest(rows, scratch(e)), exact)
    return found.select("ids", "neighbours", (c("found") >= 0.9 * c("neighbours")).alias("enough"))


add("ai10_quoted_label", lambda e: e.table("rfm_segments").select(
    "customer_id", quoted_label(F.concat(F.lit("The segment is "), "rfm_segment", F.lit(".")))
    .alias("label")))
add("ai11_identity_insights", lambda e: enrichment.identity_insights(e.table("gold_customer_360")))

# -- marts -------------------------------------------------------------------------------

add("mrt01_inventory_risk", lambda e: e.plan("inventory_risk"))
add("mrt02_stockout_alerts", lambda e: e.plan("stockout_alerts"))


@query("mrt02_stockout_alerts_rerun")
def _(e):
    """Second run: alerts of products that are now well stocked are closed."""
    before = e.table("stockout_alerts")
    restocked = e.table("inventory_risk").filter(
        ~((c("risk_level") == "CRITICAL") & (c("pending_orders") == 0)))
    return inventory.stockout_alerts(restocked, before, "2024-02-01 00:00:00")


add("mrt03_platform_profiles", lambda e: e.plan("platform_profiles"))
add("mrt04_cross_platform_identity", lambda e: e.plan("cross_platform_identity"))
add("mrt05_cross_platform_marketing", lambda e: e.plan("cross_platform_marketing"))

# -- streaming ----------------------------------------------------------------------------


def _landing(e):
    e.table("realtime_order_events")
    return e.store.current("realtime_order_events")


def _activity(e) -> ActivityJobs:
    return ActivityJobs(e.spark, _landing(e), scratch(e))


add("str01_change_stream", lambda e: QUERIES["src07_change_stream"](e))


@query("str02_land_with_ids")
def _(e):
    store = scratch(e)
    bare = e.table("realtime_order_events").drop("event_id")
    changes.land(bare.filter("is_returned"), store, "landing", 0, e.now)
    changes.land(bare.filter("NOT is_returned"), store, "landing", 1, e.now)
    return store.read("landing", schemas.ORDER_EVENTS)


@query("str03_stream_customer_activity")
def _(e):
    jobs = _activity(e)
    jobs.run_customers()
    return jobs.customers()


@query("str04_stream_seller_activity")
def _(e):
    jobs = _activity(e)
    jobs.run_sellers()
    return jobs.sellers()


@query("str04_sketched_reach")
def _(e):
    """Estimates of streamed sketches against exact numbers: within four standard errors, or half a customer."""
    store = scratch(e)
    run_reach(e.spark, _landing(e), store)
    exact = e.table("realtime_order_events").groupBy("seller_id").agg(F.count_distinct("customer_id").alias("exact"))
    near = F.abs(c("recent_unique_customers") - c("exact")) <= F.greatest(F.lit(0.5), 4 * 1.04 / 64 * c("exact"))
    return exact.join(reach(store), "seller_id", "full").select("seller_id", "exact", F.coalesce(near, F.lit(False)).alias("near"))


add("str03_customer_activity", lambda e: e.plan("customer_recent_activity"))
add("str04_seller_activity", lambda e: e.plan("seller_recent_activity"))
add("str05_customer_live", lambda e: e.plan("customer_live"))
add("str06_seller_live", lambda e: e.plan("seller_live"))


def _streamed_live(e):
    jobs = _activity(e)
    jobs.run_customers()
    jobs.run_sellers()
    return jobs.refresh_live(
        e.table("forecast_customer_outlook"), e.table("forecast_seller_outlook"), e.now)


add("str05_changed_buckets_customer_live", lambda e: run_live_customers(
    e.spark, _landing(e), scratch(e), e.table("forecast_customer_outlook"), e.now, buckets=16).read())
add("str06_changed_buckets_seller_live", lambda e: run_live_sellers(
    e.spark, _landing(e), scratch(e), e.table("forecast_seller_outlook"), e.now, buckets=16).read())
add("str05_stream_customer_live", lambda e: _streamed_live(e)[0])
add("str06_stream_seller_live", lambda e: _streamed_live(e)[1])


@query("str07_run_when_data_arrives")
def _(e):
    """Two runs over the same landing folder: the second finds nothing new."""
    store, runs = scratch(e), []
    for n in range(2):
        sink = lambda b, epoch, n=n: store.append("runs", b.agg(
            F.lit(n).alias("run"), F.count("*").alias("events")), epoch)
        changes.run(changes.event_stream(e.spark, _landing(e)), sink, store.path("_checkpoints", "r"))
    return store.read("runs").groupBy("run").agg(F.sum("events").alias("events"))


@query("str08_standing_query")
def _(e):
    """A standing query with an interval, stopped when all files are read."""
    store = scratch(e)
    sink = lambda b, epoch: store.append("seen", b.agg(F.count("*").alias("events")), epoch)
    running = changes.run(changes.event_stream(e.spark, _landing(e)), sink,
                          store.path("_checkpoints", "s"), every="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return store.read("seen").agg(F.sum("events").alias("events"))


add("str09_has_new_data", lambda e: changes.has_new_data(
    e.table("realtime_order_events"), e.table("realtime_order_events").filter("NOT is_returned")
    .select("event_id")))
add("str10_merged_orders", lambda e: _merged(e).drop("event_id", "seller_id"))


def _writeback(e) -> Store:
    store = scratch(e)
    run_writeback(e.spark, _landing(e), store, e.table("orders"), e.table("customers"))
    return store


add("str10_stream_merged_orders", lambda e: _writeback(e).read("orders_merged", schemas.ORDERS))
@query("str11_writeback_with_a_new_checkpoint")
def _(e):
    """All events are read again after the checkpoint is lost; each is merged once."""
    store = scratch(e)
    for name in ("first", "second"):
        run_writeback(e.spark, _landing(e), store, e.table("orders"), e.table("customers"), checkpoint=name)
    return store.read("orders_merged", schemas.ORDERS)


add("str11_merge_ledger", lambda e: _writeback(e).read("realtime_events_merged", schemas.EVENT_LEDGER))
add("str12_merged_mapping", lambda e: merge.mapping_rows(_merged(e)))
add("str13_changed_customers", lambda e: reports.watch_customers(e.table("customer_live")))
add("str13_changed_sellers", lambda e: reports.watch_sellers(e.table("seller_live")))
add("str14_stream_totals", lambda e: reports.stream_totals(e.table("realtime_order_events")))
add("str14_changed_customer_totals", lambda e: reports.changed_totals(e.table("customer_live")))
add("str14_changed_seller_totals", lambda e: reports.changed_totals(e.table("seller_live")))
add("str14_customer_activity_peak", lambda e: reports.activity_peak(e.table("customer_recent_activity")))
add("str14_seller_activity_peak", lambda e: reports.activity_peak(e.table("seller_recent_activity")))
add("str15_recency_tiers", lambda e: e.table("customer_recent_activity").select(
    "customer_id", *[(c("last_event_time") >= F.lit(e.now).cast("timestamp_ntz") - F.expr(
        f"INTERVAL {h} HOURS")).alias(f"within_{h}h") for h in (1, 6)]))
add("str16_nonempty_batches", lambda e: QUERIES["src06_batch_snapshot"](e))
add("str17_windowed_activity", lambda e: windows.windowed_activity(
    e.table("realtime_order_events"), "1 day", "12 hours"))
add("str18_session_activity", lambda e: windows.session_activity(e.table("realtime_order_events")))

# -- reports ------------------------------------------------------------------------------


def _report(name: str, fn, *tables: str) -> None:
    add(name, lambda e: fn(*[e.table(t) for t in tables]))


FC, FS = "forecast_customer_outlook", "forecast_seller_outlook"
_by = lambda column, label: (lambda df: reports.by_count(df, column, label))

_report("rpt01_customer_totals", reports.customer_totals, "customers")
_report("rpt02_customers_by_tier", reports.customers_by_tier, "customers")
_report("rpt03_top_customers", reports.top_customers, "customers")
_report("rpt04_tier_category_value", reports.tier_category_value, "order_fact")
_report("rpt05_customer_forecast_kpis", reports.customer_forecast_kpis, FC)
_report("rpt06_churn_levels", _by("churn_prediction_30d", "churn_level"), FC)
_report("rpt07_retention_priorities", _by("retention_priority", "priority"), FC)
_report("rpt08_tier_migrations", reports.tier_migrations, FC)
_report("rpt09_persona_stability", _by("persona_stability", "stability"), FC)
_report("rpt10_interventions", reports.interventions, FC)
_report("rpt11_customer_forecast_detail", reports.customer_forecast_detail, FC)
add("rpt11_customer_forecast_detail_high",
    lambda e: reports.customer_forecast_detail(e.table(FC), "HIGH"))
_report("rpt12_seller_forecast_kpis", reports.seller_forecast_kpis, FS)
_report("rpt13_seller_risk_levels", _by("risk_forecast", "risk_level"), FS)
_report("rpt14_investments", _by("investment_recommendation", "recommendation"), FS)
_report("rpt15_growth_trends", reports.growth_trends, FS)
_report("rpt16_operational_health", _by("operational_health_forecast", "health"), FS)
_report("rpt17_seller_actions", reports.seller_actions, FS)
_report("rpt18_seller_forecast_detail", reports.seller_forecast_detail, FS)
add("rpt18_seller_forecast_detail_high",
    lambda e: reports.seller_forecast_detail(e.table(FS), "HIGH"))
_report("rpt19_live_stats", reports.live_stats, "realtime_order_events", "orders")
_report("rpt20_alert_board", alerts.alert_board, "sellers", FS, "customer_live", "seller_live",
        "inventory_risk", "stockout_alerts")
QUERIES["set01_union_of_counts"] = QUERIES["rpt20_alert_board"]
_report("rpt21_changed_customers", reports.changed_customers, "customer_live")
_report("rpt22_changed_sellers", reports.changed_sellers, "seller_live")
_report("rpt23_inventory_summary", reports.inventory_summary, "inventory_risk")
_report("rpt24_open_stock_alerts", reports.open_stock_alerts, "stockout_alerts")
_report("rpt25_at_risk_by_category", reports.at_risk_by_category, "inventory_risk")
_report("rpt26_stockout_sellers", reports.stockout_sellers, "inventory_risk")
_report("rpt27_cross_platform_segments", reports.cross_platform_segments, "cross_platform_identity")
_report("rpt28_marketing_segments", reports.marketing_segments, "cross_platform_marketing")
_report("rpt29_vip_customers", reports.vip_customers, "cross_platform_identity")
_report("rpt30_campaign_recommendations", reports.campaign_recommendations,
        "cross_platform_marketing")
add("rpt31_customer_profile", lambda e: reports.customer_profile(e.table("customers"), ONE_CUSTOMER))
add("rpt32_customer_recent_orders",
    lambda e: reports.customer_recent_orders(e.table("orders"), ONE_CUSTOMER))
add("rpt33_customer_loyalty", lambda e: reports.customer_loyalty(
    e.table("rfm_segments"), e.table("customers"), ONE_CUSTOMER))
add("rpt34_customer_platforms",
    lambda e: reports.customer_platforms(e.table("platform_profiles"), ONE_CUSTOMER))
_report("rpt35_top_sellers_by_rating", reports.top_sellers_by_rating, "sellers")
_report("rpt35_top_sellers_by_orders", reports.top_sellers_by_orders, "sellers")
_report("rpt36_seller_kpis_by_tier", reports.seller_kpis_by_tier, "sellers")
_report("rpt37_customer_order_sample", reports.customer_order_sample, "customers", "orders")
_report("rpt37_busiest_customers", reports.busiest_customers, "customers", "orders")
add("rpt38_sellers_named", lambda e: reports.sellers_named(e.table("sellers"), NAMED_SELLERS))


def _all_orders(e):
    return e.table("orders").unionByName(merge.order_rows(_merged(e)))


add("rpt39_latest_merged_orders", lambda e: reports.latest_orders(
    _all_orders(e), merge.max_id(e.table("orders"))))
add("rpt39_orders_before_after", lambda e: e.table("orders").agg(
    F.count("*").alias("orders_before")).withColumns({
        "orders_after": _all_orders(e).agg(F.count("*")).scalar(),
        "mapping_count": e.table("customer_seller_mapping").unionByName(
            merge.mapping_rows(_merged(e))).agg(F.count("*")).scalar()}))
for _t, _k in {"customers": "customer_id", "marketing_interactions": "interaction_id",
               "gold_customer_360": "customer_id", "customer_ai_360": "customer_id",
               FC: "customer_id", FS: "seller_id", "sellers": "seller_id",
               "customer_seller_mapping": "order_id"}.items():
    add(f"rpt40_preview_{_t}", lambda e, t=_t, k=_k: topk.first_k(e.table(t), k, 10))

# -- SQL over views and table functions ------------------------------------------------------


def _asked(name: str, text: str, *views: str, **values) -> None:
    add(f"udx02_{name}", lambda e: ask(e, text, list(views), **values))


_asked("customer_profile", "SELECT * FROM customer_profile(:id)", "customers", id=ONE_CUSTOMER)
_asked("customer_recent_orders", "SELECT * FROM customer_recent_orders(:id)", "orders", id=ONE_CUSTOMER)
_asked("customer_loyalty", "SELECT * FROM customer_loyalty(:id)", "rfm_segments", "customers", id=ONE_CUSTOMER)
_asked("customer_platforms", "SELECT * FROM customer_platforms(:id)", "platform_profiles", id=ONE_CUSTOMER)
_asked("customers_at_risk", "SELECT * FROM customers_at_risk(:level)", FC, level="HIGH")
_asked("sellers_at_risk", "SELECT * FROM sellers_at_risk()", FS)
_asked("orders_of_tier", """SELECT o.category, count(*) AS orders, count_if(o.order_date < souk_as_of) AS before_today
    FROM orders o JOIN customers c ON o.customer_id = c.customer_id WHERE lower(c.loyalty_tier) = :tier GROUP BY o.category""",
       "orders", "customers", tier="gold")

# -- alerts -------------------------------------------------------------------------------

_report("alr01_seller_fraud", alerts.fraud_details, "sellers")
_report("alr02_churn", alerts.churn_details, FC)
_report("alr04_seller_risk", alerts.seller_risk_details, FS)
_report("alr09_stock_out", alerts.stock_out_details, "sellers")
_report("alr_all_alerts", alerts.alerts, "sellers", FC, FS)
add("alr05_strict_downgrades", lambda e: alerts.alerts(
    e.table("sellers"), e.table(FC), e.table(FS), strict=True).filter("alert_id = 5"))
for _n, _key in {3: "alr03_critical_retention", 5: "alr05_tier_downgrades",
                 6: "alr06_operational_health", 7: "alr07_high_rto", 8: "alr08_retargeting",
                 10: "alr10_cod_dependency", 11: "alr11_low_sustainability"}.items():
    add(_key, lambda e, n=_n: QUERIES["alr_all_alerts"](e).filter(c("alert_id") == n))
add("alr12_report_rollup", lambda e: alerts.fired(QUERIES["alr_all_alerts"](e)))

# -- business questions ----------------------------------------------------------------------

_report("qst1_high_risk_seller_revenue", reports.high_risk_seller_revenue, FS)
_report("qst2_persona_revenue_at_risk", reports.persona_revenue_at_risk, FC)
_report("qst3_predicted_tier_drops", reports.predicted_tier_drops, FC)
_report("qst4_churn_heavy_categories", reports.churn_heavy_categories, FC,
        "customer_seller_mapping", "sellers")
_report("qst5_top_clv_with_sellers", reports.top_clv_with_sellers, FC,
        "customer_seller_mapping", "sellers")
_report("qst6_order_value_by_persona_and_tier", reports.order_value_by_persona_and_tier,
        "seller_orders", "customer_ai_360", "sellers")
_report("qst7_critical_customers_with_sellers", reports.critical_customers_with_sellers, FC,
        "customer_seller_mapping", FS)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return portable(QUERIES[name](engine_for(spark, folder)))
