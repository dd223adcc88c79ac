from collections import Counter, defaultdict
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.operators import joins, topk
from souk.operators.profile import Profile, distinct_counts, value_profile
from tests.helpers import as_set, by, frame, plan_text


def skewed(spark, n=900):
    """A third of the rows belong to key 0, some have no key."""
    rng = random.Random(1)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else (None if i % 50 == 1 else rng.randrange(1, 40))
        rows.append({"id": i, "key": key, "a": rng.choice(["x", "y", "z", None]), "b": str(i % 17)})
    return rows, frame(spark, rows)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_split_join_equals_plain_join(spark, how, hot_rows):
    _, facts = skewed(spark)
    dim = spark.range(0, 30).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    got = joins.split_join(facts, dim, "key", "id", how, hot_rows=hot_rows)
    want = facts.join(dim, "key", how)
    assert as_set(got.select(*sorted(got.columns))) == as_set(want.select(*sorted(want.columns)))


def test_hot_keys_are_those_above_the_limit(spark):
    rows, facts = skewed(spark)
    counts = Counter(r["key"] for r in rows if r["key"] is not None)
    got = {r.key for r in joins.hot_keys(facts, "key", 100).collect()}
    assert got == {k for k, n in counts.items() if n > 100} == {0}


def test_hot_rows_reach_many_sub_keys(spark):
    _, facts = skewed(spark)
    dim = spark.range(0, 50).select(F.col("id").alias("key"))
    text = plan_text(joins.split_join(facts, dim, "key", "id", hot_rows=10))
    assert "_sub" in text


def test_not_in(spark):
    _, facts = skewed(spark)
    seen = facts.filter("id < 800").select("id")
    assert {r.id for r in joins.not_in(facts, seen, "id").collect()} == set(range(800, 900))


@pytest.mark.parametrize("null_is_value", [False, True])
def test_value_profile_matches_counting(spark, null_is_value):
    rows, df = skewed(spark)
    rows = [r for r in rows if r["key"] is not None]
    spec = Profile(
        modes={"top_a": "a", "top_b": "b"}, distincts={"n_a": "a"}, largest={"max_b": "b"},
        null_is_value=null_is_value,
    )
    got = by(value_profile(df.filter("key is not null"), "key", spec), "key")
    groups = defaultdict(list)
    for r in rows:
        groups[r["key"]].append(r)
    assert set(got) == set(groups)
    for key, members in groups.items():
        counts = Counter(m["a"] for m in members if null_is_value or m["a"] is not None)
        best = min(counts, key=lambda v: (-counts[v], v is None, v or "")) if counts else None
        assert got[key].top_a == best
        assert got[key].n_a == len({m["a"] for m in members} - {None})
        assert got[key].max_b == max(m["b"] for m in members)


def test_profile_of_missing_values_only(spark):
    df = frame(spark, [{"key": 1, "a": None, "b": "x"}, {"key": 1, "a": None, "b": "y"}],
               a=T.StringType())
    r = value_profile(df, "key", Profile(modes={"m": "a", "b": "b"}, distincts={"n": "a"})).first()
    assert (r.m, r.n, r.b) == (None, 0, "x")


def test_distinct_counts(spark):
    rows, df = skewed(spark)
    got = by(distinct_counts(df.filter("key is not null"), "key", {"ids": "id", "as": "a"}), "key")
    for key in got:
        members = [r for r in rows if r["key"] == key]
        assert got[key].ids == len(members)
        assert got[key]["as"] == len({m["a"] for m in members} - {None})


def test_top_k_breaks_ties_by_key(spark):
    df = frame(spark, [{"k": k, "v": v} for k, v in [(3, 5), (1, 5), (2, 9), (4, 1)]])
    assert [r.k for r in topk.top_k(df, "v", 3, "k").collect()] == [2, 1, 3]
    assert "TakeOrderedAndProject" in plan_text(topk.top_k(df, "v", 3, "k"))


def test_sample_repeats_and_depends_on_seed(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = as_set(topk.sample_k(df, "k", "s", 20))
    assert a == as_set(topk.sample_k(df.repartition(9), "k", "s", 20))
    assert a != as_set(topk.sample_k(df, "k", "t", 20)) and len(set(a)) == 20


def test_chosen_filter(spark):
    df = frame(spark, [{"p": "HIGH"}, {"p": "LOW"}, {"p": "it's"}])
    assert topk.chosen(df, "p", "ALL").count() == 3
    assert topk.chosen(df, "p", "HIGH").count() == 1
    assert topk.chosen(df, "p", "it's").count() == 1
    assert topk.chosen(df, "p", "x' OR 1=1 --").count() == 0


def test_measures_become_rows(spark):
    df = spark.range(4).agg(F.count("*").cast("double").alias("n"), F.max("id").cast("double").alias("m"))
    assert as_set(topk.as_rows(df, "name", "value")) == [("m", 3.0), ("n", 4.0)]


@pytest.mark.parametrize("ranges, kind", [(4096, "bigint"), (4096, "int"), (1, "bigint"), (4096, "string")])
def test_rows_of_known_keys(spark, ranges, kind):
    """Of whole numbers near and far, below zero, repeated and null, and of texts; by bitmaps or by a join."""
    far = [] if kind == "int" else [2**62, -(2**62), -(2**63)]
    ids = [None, 0, 1, 1, -1, 32_767, 32_768, 32_769, -32_768, *far]
    others = [None, 2, 2, -2, 32_766, -32_767, 70_000, *[i // 2 for i in far]]
    keys = spark.createDataFrame([(i,) for i in ids], "k long").select(F.col("k").cast(kind).alias("k"))
    facts = spark.createDataFrame([(i, n) for n, i in enumerate([*ids, *others])], "k long, v long")
    facts = facts.select("v", F.col("k").cast(kind).alias("k"))
    found = joins.known_keys(facts, keys, "k", spread="v", ranges=ranges)
    assert found.schema == facts.schema
    assert as_set(found) == as_set(facts.join(keys, "k", "left_semi").select("v", "k"))
    assert joins.known_keys(facts, keys.where("false"), "k", spread="v", ranges=ranges).isEmpty()


def test_rows_of_known_keys_are_not_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = spark.range(1_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        found = joins.known_keys(facts, spark.range(500).select(F.col("id").alias("k")), "k", spread="v")
        text = plan_text(found)
        assert found.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in text and not re.search(r"hashpartitioning\(k#", text)
