"""Top-k, distributions, samples and conditional one-row reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.hashing import salted_hash

ALL = "ALL"


def top_k(df: DataFrame, measure: str, k: int, tie: str) -> DataFrame:
    """The k largest rows; per-partition heaps, no global sort. Nulls count as largest."""
    return df.orderBy(F.col(measure).desc_nulls_first(), F.col(tie).asc()).limit(k)


def first_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """Preview of k rows, by key so that it repeats."""
    return df.orderBy(key).limit(k)


def sample_k(df: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    """Repeatable random sample of k rows: the k smallest salted hashes."""
    mixed = df.withColumn("_mix", salted_hash(F.col(key), seed))
    return mixed.orderBy("_mix", key).limit(k).drop("_mix")


def distribution(df: DataFrame, column: str, label: str, *measures: Column) -> DataFrame:
    """Rows (and extra measures) per value of ``column``."""
    return df.groupBy(F.col(column).alias(label)).agg(F.count("*").alias("count"), *measures)


def chosen(df: DataFrame, column: str, value: str) -> DataFrame:
    """Filter picked by a user; ``ALL`` keeps everything."""
    return df if value == ALL else df.filter(F.col(column) == F.lit(value))


def as_rows(one_row: DataFrame, key: str, value: str) -> DataFrame:
    """Turn a one-row frame of measures into (name, value) rows."""
    return one_row.unpivot([], one_row.columns, key, value)
