import json
import os
import time

import pytest
from pyspark.sql import functions as F

from souk.sources import schemas
from souk.sources.seller_json import ingest_sellers
from souk.sources.buckets import Bucketed
from souk.sources.store import CLEANUP, Store, shared_root, typed_read, with_defaults
from tests.helpers import as_set, frame


def test_replace_reads_its_own_previous_version(spark, store):
    store.replace("t", spark.range(3).toDF("x"))
    store.replace("t", store.read("t").withColumn("x", F.col("x") + 10))
    assert as_set(store.read("t")) == [(10,), (11,), (12,)]


def test_unfinished_version_is_not_read(spark, store):
    store.replace("t", spark.range(3).toDF("x"))
    spark.range(99).toDF("x").write.parquet(store.path("t", "v=000002"))
    os.remove(store.path("t", "v=000002", "_SUCCESS"))
    assert store.read("t").count() == 3
    store.replace("t", spark.range(5).toDF("x"))
    assert store.read("t").count() == 5


def test_clustered_table_keeps_rows_and_prunes(spark, store):
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    got = store.replace("c", df.repartition(6), cluster_by="k")
    assert as_set(got) == as_set(df)


def test_append_of_the_same_epoch_replaces_it(spark, store):
    store.append("t", spark.range(2).toDF("x"), 0)
    store.append("t", spark.range(5, 7).toDF("x"), 1)
    store.append("t", spark.range(8, 9).toDF("x"), 1)
    assert as_set(store.read("t")) == [(0,), (1,), (8,)]
    schema = spark.range(1).toDF("x").schema
    assert as_set(store.read_before("t", 1, schema)) == [(0,), (1,)]
    assert store.read_before("t", 0, schema).count() == 0


def test_create_if_absent_keeps_existing_rows(spark, store):
    assert store.create_if_absent("led", schemas.EVENT_LEDGER).count() == 0
    store.append("led", spark.range(2).toDF("event_id"), 0)
    assert store.create_if_absent("led", schemas.EVENT_LEDGER).count() == 2


def test_missing_table(store):
    with pytest.raises(FileNotFoundError):
        store.read("nothing")


def test_typed_read_uses_the_declared_columns(spark, store):
    path = store.path("raw")
    spark.range(2).select(F.col("id").alias("event_id"), F.lit("x").alias("other")).write.parquet(path)
    assert typed_read(spark, path, schemas.EVENT_LEDGER).columns == ["event_id"]


def test_defaults_fill_and_add(spark):
    df = frame(spark, [{"a": True}, {"a": None}])
    got = with_defaults(df, {"a": F.lit(False), "b": F.lit(3)})
    assert as_set(got) == [(False, 3), (True, 3)]


def test_shared_root_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_schema_sizes():
    assert {n: len(s.fields) for n, s in schemas.BASE_TABLES.items()} == {
        "customers": 50,
        "orders": 39,
        "marketing_interactions": 39,
        "sellers": 52,
        "customer_seller_mapping": 5,
        "realtime_order_events": 11,
        "realtime_events_merged": 1,
    }


def test_seller_json(spark):
    good = {"seller_id": 5, "seller_name": "A", "total_revenue": 12.5, "is_top_seller": True,
            "seller_onboard_date": "2020-02-03", "unknown_field": [1]}
    odd = {"seller_id": 6, "years_on_platform": "many", "is_top_seller": "maybe"}
    texts = [json.dumps([good, None, odd]), "[]", "not json", None, json.dumps([])]
    raw = spark.createDataFrame([(t,) for t in texts], "json_data string")
    rows = {r.seller_id: r for r in ingest_sellers(raw).collect()}
    assert set(rows) == {5, 6}
    assert rows[5].total_revenue == 12.5 and rows[5].is_top_seller is True
    assert str(rows[5].seller_onboard_date) == "2020-02-03"
    assert rows[6].years_on_platform is None and rows[6].is_top_seller is None
    assert ingest_sellers(raw).schema == schemas.SELLERS


def test_stored_tables_leave_no_shuffle_files(spark, store):
    """Of a chain of stored tables only those are on disk; queries that are not stored keep what they shuffled."""
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    rows = spark.range(1_000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    before = shuffled()
    stored = store.replace("t", rows, cluster_by="k")
    stored = store.replace("t", stored.groupBy("k").agg(F.sum("v").alias("v")))
    store.append("a", rows.distinct(), 0)
    Bucketed(store, "b", "k", rows.schema, 2).write(rows)
    for _ in range(50):  # Spark removes them by and by
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(CLEANUP, "false") == "false"
    assert stored.count() == 7 and store.read("a").count() == 1_000
