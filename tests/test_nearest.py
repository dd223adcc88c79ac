"""Nearest vectors against all pairs in numpy, hot classes and hot buckets included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from souk.operators import nearest
from tests.helpers import as_set


def clustered(n=300, dims=24, groups=30, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dims))
    return [(i, [float(x) for x in middle[i % groups] + 0.25 * rng.normal(size=dims)]) for i in range(n)]


def table(spark, rows):
    return nearest.entries(spark.createDataFrame(rows, "k long, v array<double>").repartition(4), "k", "v")


def exact(rows, k, least=0.0):
    ids = [i for i, v in rows if any(v)]
    x = np.array([v for _, v in rows if any(v)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 8)
    out = []
    for a, i in enumerate(ids):
        near = sorted((-float(sims[a, b]), j) for b, j in enumerate(ids) if b != a and sims[a, b] > least)[:k]
        out += [(i, p + 1, j, -s) for p, (s, j) in enumerate(near)]
    return out


def test_exact_equals_all_pairs(spark, store):
    rows = [(i, [abs(x) for x in v]) for i, v in clustered(60)]
    rows += [(100 + i, rows[3][1]) for i in range(8)] + [(200, [0.0] * 24)]
    got = nearest.nearest(table(spark, rows), store, k=4, exact=True).collect()
    want = exact(rows, 4)
    assert sorted((r.id, r.place) for r in got) == sorted(w[:2] for w in want)
    sims = {(i, p): s for i, p, _, s in want}
    assert all(abs(r.similarity - sims[r.id, r.place]) < 1e-7 for r in got)
    # equal vectors are each other's nearest, smallest id first
    assert [r.neighbour for r in sorted(got, key=lambda r: r.place) if r.id == 100] == [3, 101, 102, 103]


@pytest.mark.parametrize("cap", [256, 4])
def test_buckets_find_nine_of_ten(spark, store, cap):
    rows = clustered()
    found = nearest.nearest(table(spark, rows), store, k=5, tables=30, cap=cap)
    wanted = spark.createDataFrame(exact(rows, 5), "id long, place long, neighbour long, similarity double").withColumn("similarity", F.col("similarity") - 1e-7)
    score = nearest.recall(found, wanted).first()
    assert score.ids == 300 and score.found >= 0.9 * score.neighbours


def test_hot_buckets_are_split(spark):
    signed = spark.range(2_000).select(F.col("id").cast("string").alias("class"), F.array(F.xxhash64("id").bitwiseAND(F.lit(-32).cast("bigint"))).alias("bits"))
    # the five lowest bits, a table's bucket, are 0 for all: one bucket of everything
    largest = lambda df: df.groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert largest(nearest.buckets(signed, 1, 5, cap=5_000)) == 2_000
    assert largest(nearest.buckets(signed, 1, 5, cap=100)) < 130
    assert nearest.buckets(signed, 1, 5, cap=100).count() == 2_000


def test_a_hot_class_is_compared_once(spark, store):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(900, [1.0, 2.1])]
    got = nearest.nearest(table(spark, rows), store, k=3, exact=True)
    assert got.count() == 3 * 501
    assert [r.neighbour for r in got.where("id = 900").orderBy("place").collect()] == [0, 1, 2]
    assert [r.neighbour for r in got.where("id = 1").orderBy("place").collect()] == [0, 2, 3]


def test_odd_vectors(spark, store):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [0.0, 2.0])]
    got = nearest.nearest(table(spark, rows), store, k=2, exact=True)
    assert {r[0] for r in as_set(got)} == {4, 5, None} or {r[0] for r in as_set(got)} == {4, 5}
    assert all(r.similarity == 1.0 for r in got.collect())
    assert nearest.nearest(table(spark, []), store, exact=True).collect() == []
