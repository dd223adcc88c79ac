"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).

Loading the base tables and building every mart are timed as entries of their
own (``load_base_tables``, ``refresh_all_marts``); the other entries time a
query on top of the stored tables, including the collection of its rows into
a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

BASE = ["customers", "orders", "marketing_interactions", "sellers", "realtime_order_events",
        "customer_seller_mapping"]
HEADLINE = """job01_customer_order_facts job02_customer_marketing_facts job03_gold_customer_360
    job04_order_fact job05_seller_order_metrics job06_seller_customer_metrics
    job07_seller_top_values job08_gold_seller_360 job09_customer_ai_360 job10_rfm_scores
    job13_forecast_customer_outlook job14_forecast_customer_outlook_v2
    job15_forecast_seller_outlook job16_customer_seller_mapping job17_refresh_after_writeback win03_global_row_number
    str03_customer_activity str05_customer_live str06_seller_live
    str03_stream_customer_activity str10_merged_orders mrt01_inventory_risk
    mrt03_platform_profiles mrt04_cross_platform_identity mrt05_cross_platform_marketing
    rpt02_customers_by_tier rpt05_customer_forecast_kpis rpt20_alert_board
    rpt37_busiest_customers alr_all_alerts qst4_churn_heavy_categories
    qst6_order_value_by_persona_and_tier""".split()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    from souk.engine import engine_for
    from souk.registry import run
    from souk.session import local_session

    spark = local_session(CPUS, "souk-bench")
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    engine = engine_for(spark, FOLDER)
    seconds = {
        "load_base_tables": timed(lambda: [engine.table(n) for n in BASE]),
        "refresh_all_marts": timed(engine.refresh),
    }
    # Marts that only some queries need are written before those are timed.
    for name in ("order_fact", "inventory_risk", "stockout_alerts", "platform_profiles",
                 "cross_platform_identity"):
        engine.table(name)
    sink = lambda n: run(n, spark, FOLDER).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        seconds[name] = timed(lambda n=name: sink(n))
    print(json.dumps({
        "metric": "total wall time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
