import hashlib
import random

from pyspark.sql import functions as F

from souk.functions import exact, hashing, nulls, text
from souk.functions.ladders import choose, ladder
from tests.helpers import by, frame


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_bounds_propagate_null(spark):
    none = F.lit(None).cast("double")
    r = one(
        spark,
        low=nulls.least_n(1.0, F.lit(2.0)),
        low_null=nulls.least_n(1.0, none),
        high=nulls.greatest_n(0.0, F.lit(-3.0)),
        high_null=nulls.greatest_n(none, 0.0),
        inside=nulls.clamp(F.lit(50.0), 0.0, 100.0),
        under=nulls.clamp(F.lit(-1.0), 0.0, 100.0),
        over=nulls.clamp(F.lit(101.0), 0.0, 100.0),
        unknown=nulls.clamp(none, 0.0, 100.0),
    )
    assert (r.low, r.low_null, r.high, r.high_null) == (1.0, None, 0.0, None)
    assert (r.inside, r.under, r.over, r.unknown) == (50.0, 0.0, 100.0, None)


def test_inline_conditional_takes_else_for_null(spark):
    r = one(
        spark,
        yes=nulls.iff(F.lit(True), 1, 0),
        no=nulls.iff(F.lit(False), 1, 0),
        unknown=nulls.iff(F.lit(None).cast("boolean"), 1, 0),
    )
    assert (r.yes, r.no, r.unknown) == (1, 0, 0)


def test_percentage_of_nothing_is_null(spark):
    r = one(spark, a=nulls.pct(F.lit(1), F.lit(3)), b=nulls.pct(F.lit(1), F.lit(0)))
    assert (r.a, r.b) == (33.33, None)


def test_sign_like_defaults_differ_above_and_below(spark):
    values = {"big": 4.0, "small": 0.5, "loss": -2.0, "none": None}
    r = one(spark, **{n: nulls.sign_like(F.lit(v).cast("double")) for n, v in values.items()})
    assert (r.big, r.small, r.loss, r.none) == (1.0, 0.5, -1.0, 0.0)


def test_exact_sum_ignores_order_and_partitioning(spark):
    rng = random.Random(3)
    amounts = [rng.randrange(1, 10**9) / 100 for _ in range(5000)]
    sums = set()
    for parts in (1, 7, 16):
        rng.shuffle(amounts)
        df = spark.createDataFrame([(a,) for a in amounts], "a double").repartition(parts)
        sums.add(df.agg(exact.exact_sum(F.col("a")).alias("s")).first().s)
    assert sums == {sum(round(a * 10000) for a in amounts) / 10000}


def test_exact_average_skips_nulls(spark):
    df = frame(spark, [{"k": 1, "a": 1.25}, {"k": 1, "a": None}, {"k": 1, "a": 2.25}, {"k": 2}])
    got = by(df.groupBy("k").agg(exact.exact_avg(F.col("a")).alias("m")), "k")
    assert got[1].m == 1.75 and got[2].m is None


def test_weighted_average(spark):
    rows = [{"a": 10.0, "w": 1}, {"a": 20.0, "w": 3}, {"a": None, "w": 5}]
    df = frame(spark, rows)
    assert df.agg(exact.weighted_avg(F.col("a"), F.col("w")).alias("m")).first().m == 17.5


def test_salted_hash_is_md5_prefix(spark):
    df = spark.range(20).select("id", hashing.salted_hash(F.col("id"), "qty").alias("h"))
    for r in df.collect():
        assert r.h == int(hashlib.md5(f"{r.id}qty".encode()).hexdigest()[:8], 16)


def test_pick_from_uses_zero_based_index(spark):
    options = ["a", "b", "c"]
    df = spark.range(50).select(
        hashing.salted_pick(F.col("id"), "s", 3).alias("i"),
        hashing.pick_from(F.col("id"), "s", options).alias("o"),
    )
    rows = df.collect()
    assert all(r.o == options[r.i] for r in rows) and {r.o for r in rows} == set(options)


def test_ladder_first_match_wins_and_null_falls_through(spark):
    rules = [
        ("BOTH", [("a", ">", 1), ("b", "<", 5)]),
        ("A", [("a", ">", 1)]),
        ("B", [("b", "in", [7, 8])]),
        ("SAME", [("a", "=", "@b")]),
        ("NO_B", [("b", "known", False)]),
    ]
    rows = [
        {"id": 1, "a": 2, "b": 4},
        {"id": 2, "a": 2, "b": 5},
        {"id": 3, "a": 1, "b": 8},
        {"id": 4, "a": 1, "b": 1},
        {"id": 5, "a": 0, "b": None},
        {"id": 6, "a": None, "b": 3},
    ]
    got = by(frame(spark, rows).select("id", ladder(rules, "@name", {"name": F.lit("ELSE")}).alias("x")), "id")
    assert [got[i].x for i in range(1, 7)] == ["BOTH", "A", "B", "SAME", "NO_B", "ELSE"]


def test_choose_falls_back(spark):
    df = spark.range(4).select(choose(F.col("id"), {0: "x", 1: "y"}, "z").alias("v"))
    assert [r.v for r in df.collect()] == ["x", "y", "z", "z"]


def test_quoted_label(spark):
    r = one(
        spark,
        a=text.quoted_label(F.lit('The answer is "At Risk" or "Champion".')),
        b=text.quoted_label(F.lit("no quotes")),
        c=text.quoted_label(F.lit(None).cast("string")),
    )
    assert (r.a, r.b, r.c) == ("At Risk", None, None)


def test_sentiment_averages_known_words(spark):
    r = one(
        spark,
        good=text.sentiment(F.lit("Top Performer High Growth")),
        bad=text.sentiment(F.lit("Declining")),
        unknown=text.sentiment(F.lit("zzz")),
    )
    assert (r.good, r.bad, r.unknown) == (0.5, -0.8, 0.0)


def test_exact_sums_keep_small_and_large_amounts(spark):
    from souk.functions.exact import exact_avg, exact_sum, weighted_avg

    tiny = spark.range(10).withColumn("v", F.lit(0.00004))
    assert tiny.agg(exact_sum(F.col("v"))).first()[0] == 0.0004
    assert tiny.agg(exact_sum(F.lit(0.000001))).first()[0] == 0.00001
    large = spark.range(1000).withColumn("v", F.lit(1e15))
    assert large.agg(exact_sum(F.col("v"))).first()[0] == 1e18
    assert large.agg(exact_avg(F.col("v"))).first()[0] == 1e15
    assert spark.range(4).agg(weighted_avg(F.col("id") + F.lit(0.000001), F.col("id"))).first()[0] == (14 + 6e-6) / 6


def test_exact_sums_of_cents_are_added_as_whole_numbers(spark):
    """Whole cents do not pass a decimal; other amounts among them count to their eighth place."""
    from decimal import Decimal

    from souk.functions.exact import exact_sum, weighted_avg

    mixed = [0.29, -0.0, None, 1.15, 1e-8, 0.285, 999999.99, 1000000.01, 123456789.12345678, -17.1, 2.0**49]
    df = spark.createDataFrame([(v, w) for w, v in enumerate(mixed)] + [(5.25, 99), (5.25, 100), (0.1, 10**6)], "v double, w long")
    known = [(Decimal(repr(r.v)).quantize(Decimal("1e-8")), r.w) for r in df.collect() if r.v is not None]
    got = df.agg(exact_sum(F.col("v")).alias("s"), weighted_avg(F.col("v"), F.col("w")).alias("m"), exact_sum(F.lit(None).cast("double")).alias("none"))
    row = got.first()
    assert row.s == float(sum(v for v, _ in known)) and row.none is None
    assert row.m == float(sum(v * w for v, w in known)) / sum(w for _, w in known)
    for amount in (F.col("v").cast("decimal(30,12)"), F.col("w"), F.col("v").cast("float")):
        plain = df.agg(F.sum(amount.cast("decimal(28,8)")).cast("double")).first()[0]
        assert df.agg(exact_sum(amount)).first()[0] == plain
    cents = spark.range(1000).select((F.col("id") / 100).alias("v")).agg(exact_sum(F.col("v")).alias("s"))
    text = cents._jdf.queryExecution().optimizedPlan().toString()
    assert "as bigint) END)" in text and cents.first().s == 4995.0
