"""Numeric helpers with the null rules of the modelled warehouse.

Spark's ``least``/``greatest`` skip nulls.  Scores here must become null as
soon as one input is null (a customer without orders has no churn
probability), so these wrappers propagate it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _strict(pick, args) -> Column:
    cols = [as_col(a) for a in args]
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(known, pick(*cols))


def least_n(*args) -> Column:
    """Smallest argument, null when any argument is null."""
    return _strict(F.least, args)


def greatest_n(*args) -> Column:
    """Largest argument, null when any argument is null."""
    return _strict(F.greatest, args)


def clamp(value: Column, low, high) -> Column:
    return greatest_n(F.lit(low), least_n(F.lit(high), value))


def iff(condition: Column, yes, no) -> Column:
    """Inline conditional; a null condition takes the ``no`` side."""
    return F.when(condition, as_col(yes)).otherwise(as_col(no))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def pct(part: Column, whole: Column, places: int = 2) -> Column:
    """100 * part / whole, null for an empty whole (ANSI division would raise)."""
    return F.round(part * F.lit(100.0) / F.nullif(whole, F.lit(0)), places)


def sign_like(value: Column) -> Column:
    """value / max(1, |value|): a ratio squeezed into -1..1.

    A missing value counts as 0 above and as 1 below the line, so it gives 0.
    """
    below = F.abs(F.coalesce(value, F.lit(1.0)))
    return F.coalesce(value, F.lit(0.0)) / greatest_n(F.lit(1.0), below)
