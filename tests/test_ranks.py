import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.operators.ranks import Asc, Desc, global_row_number, ntile_columns
from tests.helpers import by, frame, plan_text


def values(spark, n, seed=5):
    rng = random.Random(seed)
    rows = [
        {"k": i, "v": rng.choice([None, 1.5, 2.5, 2.5, rng.randrange(100) / 4.0])} for i in range(n)
    ]
    return frame(spark, rows, v=T.DoubleType())


ORDERS = {
    "asc": ([Asc("v"), Asc("k")], lambda: [F.col("v").asc_nulls_last(), F.col("k").asc()]),
    "desc": ([Desc("v"), Asc("k")], lambda: [F.col("v").desc_nulls_first(), F.col("k").asc()]),
}


@pytest.mark.parametrize("n", [1, 4, 149])
@pytest.mark.parametrize("direction", list(ORDERS))
def test_equals_plain_window(spark, store, n, direction):
    order, plain = ORDERS[direction]
    window = Window.orderBy(*plain())
    df = values(spark, n)
    want = by(
        df.select(
            "k",
            F.row_number().over(window).alias("rn"),
            F.ntile(5).over(window).alias("t5"),
            F.ntile(7).over(window).alias("t7"),
        ),
        "k",
    )
    numbered = by(global_row_number(df, order, store, "n", slices=4), "k")
    tiles = {}
    for n_tiles in (5, 7):
        tiles |= ntile_columns(df, n_tiles, {f"t{n_tiles}": order[0]}, "k", store, "t", slices=4)
    tiles = by(df.withColumns(tiles), "k")
    for k, row in want.items():
        assert numbered[k].row_number == row.rn
        assert (tiles[k].t5, tiles[k].t7) == (row.t5, row.t7)


def test_one_value_for_a_third_of_the_rows(spark, store):
    df = spark.range(3000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v")
    )
    tiles = ntile_columns(df, 5, {"a": Asc("v"), "d": Desc("v")}, "k", store, "hot", slices=16)
    for name, tile in tiles.items():
        sizes = [r["count"] for r in df.select(tile.alias("t")).groupBy("t").count().collect()]
        assert sizes == [600] * 5


def test_several_measures_share_one_pass(spark, store):
    df = values(spark, 143).withColumn("w", F.col("k") % 10)
    measures = {"v5": Desc("v"), "w5": Asc("w"), "k5": Desc("k")}
    got = by(df.withColumns(ntile_columns(df, 5, measures, "k", store, "m", slices=4)), "k")
    plain = {
        "v5": Window.orderBy(F.col("v").desc_nulls_first(), "k"),
        "w5": Window.orderBy("w", "k"),
        "k5": Window.orderBy(F.col("k").desc()),
    }
    want = by(df.select("k", *[F.ntile(5).over(w).alias(n) for n, w in plain.items()]), "k")
    assert all(got[k][n] == want[k][n] for k in want for n in plain)


def test_empty_input(spark, store):
    df = values(spark, 1).filter("k < 0")
    assert df.withColumns(ntile_columns(df, 5, {"t": Asc("v")}, "k", store, "e")).count() == 0
    assert global_row_number(df, [Asc("k")], store, "e2").count() == 0


def test_scoring_is_a_plain_projection(spark, store):
    df = values(spark, 60)
    scored = df.withColumns(ntile_columns(df, 5, {"t": Asc("v")}, "k", store, "p"))
    assert "Exchange" not in plan_text(scored) and "Window" not in plan_text(scored)
