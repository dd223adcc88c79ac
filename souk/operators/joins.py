"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is split into sub-keys of about so many rows.
HOT_ROWS = 1_000_000


def hot_keys(facts: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and ``_splits``, their sub-keys (map-side combined count)."""
    return (
        facts.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(key, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_splits"))
    )


def split_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    spread: str,
    how: str = "inner",
    counted: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join many ``facts`` to ``dim`` (unique on ``key``), splitting hot keys.

    Rows of a hot key are spread over sub-keys, one for each ``hot_rows`` rows,
    by a hash of the ``spread`` column; the dim row of a hot key is repeated as
    often.  Rows without key are spread by the hash itself.  All other rows use
    sub-key 0.  Every row takes part,
    so the result equals the plain join.  ``how`` is inner, left or left_semi.

    ``counted`` names a cheaper frame with at least the key rows of ``facts``
    (say, a stored table ``facts`` was joined from) to find the hot keys in.

    Hot keys are broadcast: there is at most one for each ``hot_rows`` rows, and
    a shuffle to find them would send the rows of a hot key to one task.
    """
    found = F.broadcast(hot_keys(facts if counted is None else counted, key, hot_rows))
    hash_ = F.xxhash64(spread)
    sub = F.when(F.col(key).isNull(), hash_).otherwise(
        F.coalesce(F.pmod(hash_, F.col("_splits")), F.lit(0))
    )
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_splits", F.lit(1)).cast("bigint") - 1)
    left = facts.join(found, key, "left").withColumn("_sub", sub.cast("bigint")).drop("_splits")
    right = dim.join(found, key, "left").withColumn("_sub", F.explode(copies)).drop("_splits")
    return left.join(right, [key, "_sub"], how).drop("_sub")


# Bitmaps of 4 kB that may be sent to every task, 16 MB in all.
RANGES = 4096


def known_keys(facts: DataFrame, keys: DataFrame, key: str, spread: str, ranges: int = RANGES) -> DataFrame:
    """Rows of ``facts`` whose key, a whole number, occurs in ``keys``; rows without a key go, repeated rows stay.

    Keys become bitmaps of 32,768 neighbouring numbers, which are sent to every
    task: facts are not shuffled.  Keys that lie so far apart that they fill more
    than ``ranges`` bitmaps, or are no whole numbers, take the shuffled join.
    """
    types = {dict(df.dtypes)[key] for df in (facts, keys)}
    few = types <= {"tinyint", "smallint", "int", "bigint"}
    if few:
        ids = keys.where(F.col(key).isNotNull())
        places = ids.select(F.bitmap_bucket_number(key).alias("_range"), F.bitmap_bit_position(key).alias("_bit"))
        few = places.select("_range").distinct().limit(ranges + 1).count() <= ranges
    if not few:
        return split_join(facts, keys.select(key), key, spread, how="left_semi", counted=facts).select(*facts.columns)
    # Ids are shuffled, not a bitmap of each task and range.
    bits = places.repartition("_range").groupBy("_range").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bit = F.bitmap_bit_position(key)
    byte = F.conv(F.hex(F.substr(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    met = facts.join(F.broadcast(bits), F.bitmap_bucket_number(key) == F.col("_range"))
    return met.where(F.getbit(byte.cast("bigint"), (bit % 8).cast("int")) == 1).select(*facts.columns)


def not_in(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``seen`` (key is never null)."""
    return df.join(seen.select(key), key, "left_anti")
