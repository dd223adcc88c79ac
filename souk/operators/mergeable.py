"""Aggregates by key as states that add up: the state of two batches is their states' merge.

Three kinds, all exact:

* measures - one row per key with sums (as decimals), counts, smallest and largest;
* cells - one row per (key, column, value) with its count, for modes and distinct
  counts of columns with few values per key;
* bits - one row per (key, column, range of 32,768 numbers) with a bitmap, for
  distinct counts of whole numbers that lie close together.  A number costs one
  bit, however often it occurs, and bitmaps merge by OR.

A mean is a sum and a count; it is divided only when the state is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.exact import units

_MERGE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


def total(column: str) -> tuple[str, Column]:
    return "sum", F.sum(F.col(column).cast("bigint"))


def amount(column: str) -> tuple[str, Column]:
    return "sum", F.sum(units(F.col(column)))


def known(column: str) -> tuple[str, Column]:
    return "sum", F.count(column)


def rows_with(test: Column | str) -> tuple[str, Column]:
    return "sum", F.count_if(test)


def least(column: str) -> tuple[str, Column]:
    return "min", F.min(column)


def most(column: str) -> tuple[str, Column]:
    return "max", F.max(column)


@dataclass(frozen=True)
class Measures:
    """``{state column: (how it merges, aggregate over rows)}`` by key."""

    key: str
    columns: dict[str, tuple[str, Column]]

    def start(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(*[a.alias(n) for n, (_, a) in self.columns.items()])

    def merged(self, states: DataFrame) -> DataFrame:
        """One row per key; a sum keeps the type it has in the states, so that states can merge again."""
        kinds = {f.name: f.dataType for f in states.schema}
        return states.groupBy(self.key).agg(
            *[_MERGE[how](n).cast(kinds[n]).alias(n) for n, (how, _) in self.columns.items()]
        )


@dataclass(frozen=True)
class Cells:
    """Counted values of some columns by key."""

    key: str
    columns: list[str]
    null_is_value: bool = False

    def start(self, rows: DataFrame) -> DataFrame:
        cells = F.array(
            *[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in self.columns]
        )
        long = rows.select(self.key, F.inline(cells))
        if not self.null_is_value:
            long = long.where("value IS NOT NULL")
        return long.groupBy(self.key, "dim", "value").agg(F.count("*").alias("n"))

    def merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy(self.key, "dim", "value").agg(F.sum("n").alias("n"))

    def read(self, merged: DataFrame, modes: dict[str, str], distincts: dict[str, str]) -> DataFrame:
        """One row per key; ties of a mode go to the smallest value, null last."""
        best = F.struct((-F.col("n")).alias("n"), F.col("value").isNull().alias("no_value"), F.col("value"))
        return merged.groupBy(self.key).agg(
            *[F.min(F.when(F.col("dim") == c, best))["value"].alias(out) for out, c in modes.items()],
            *[F.count_if((F.col("dim") == c) & F.col("value").isNotNull()).alias(out) for out, c in distincts.items()],
        )


@dataclass(frozen=True)
class Bits:
    """Bitmaps of whole-number columns by key."""

    key: str
    columns: list[str] = field(default_factory=list)

    def start(self, rows: DataFrame) -> DataFrame:
        place = [
            F.struct(
                F.lit(c).alias("dim"),
                F.bitmap_bucket_number(F.col(c)).alias("range"),
                F.bitmap_bit_position(F.col(c)).alias("bit"),
            )
            for c in self.columns
        ]
        long = rows.select(self.key, F.inline(F.array(*place))).where("bit IS NOT NULL")
        return long.groupBy(self.key, "dim", "range").agg(F.bitmap_construct_agg("bit").alias("bits"))

    def merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy(self.key, "dim", "range").agg(F.bitmap_or_agg("bits").alias("bits"))

    def read(self, merged: DataFrame, distincts: dict[str, str]) -> DataFrame:
        """Distinct counts, one row per key."""
        n = F.bitmap_count("bits")
        return merged.groupBy(self.key).agg(
            *[F.sum(F.when(F.col("dim") == c, n).otherwise(0)).alias(out) for out, c in distincts.items()]
        )
