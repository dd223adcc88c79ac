"""Per-key value profiles: mode, distinct count and largest text in one pass.

``mode`` and ``max`` over strings push a wide aggregate off the hash path, and
several distinct counts repeat every input row.  Here the low-cardinality
columns are counted as (key, column, value) first.  That first step combines
map-side and spreads a hot key over its values; the second step sees only the
distinct values of a key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """What to derive, as ``{output: column}`` maps."""

    modes: dict[str, str] = field(default_factory=dict)
    distincts: dict[str, str] = field(default_factory=dict)
    largest: dict[str, str] = field(default_factory=dict)
    # True lets null be the most frequent value, as a GROUP BY would.
    null_is_value: bool = False

    def columns(self) -> list[str]:
        used = [*self.modes.values(), *self.distincts.values(), *self.largest.values()]
        return list(dict.fromkeys(used))


def value_profile(df: DataFrame, key: str, spec: Profile) -> DataFrame:
    """One row per key.  Ties of a mode go to the smallest value."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value"))
            for c in spec.columns()
        ]
    )
    long = df.select(key, F.explode(cells).alias("cell")).select(key, "cell.dim", "cell.value")
    if not spec.null_is_value:
        long = long.filter(F.col("value").isNotNull())
    counted = long.groupBy(key, "dim", "value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    best = F.struct((-F.col("n")).alias("n"), F.col("value").isNull().alias("no_value"), F.col("value"))

    aggs = []
    for out, col in spec.modes.items():
        aggs.append(F.min(F.when(F.col("dim") == col, best))["value"].alias(out))
    for out, col in spec.distincts.items():
        aggs.append(F.count_if((F.col("dim") == col) & known).alias(out))
    for out, col in spec.largest.items():
        aggs.append(F.max(F.when(F.col("dim") == col, F.col("value"))).alias(out))
    return counted.groupBy(key).agg(*aggs)


def distinct_counts(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Exact distinct counts of high-cardinality columns, ``{output: column}``.

    Kept apart from other measures: rows repeated per distinct column then
    carry nothing but the key and that column.  The shuffle is by
    (key, value), so a hot key does not end up in one task.
    """
    return df.groupBy(key).agg(*[F.count_distinct(c).alias(out) for out, c in columns.items()])
