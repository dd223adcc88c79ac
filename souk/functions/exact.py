"""Sums that do not depend on the order of addition.

A sum of doubles changes in its last bits with partitioning, task retries and
file order, and a value next to a rule threshold can flip a label between two
runs.  Amounts are therefore added as decimals, which are exact; a total may
have 30 digits before the point (29 where amounts are mixed, see below).
``places`` are the decimals that count.

Decimals of that size cost far more time than whole numbers.  Amounts below
``SMALL`` that are whole cents, which most are, are therefore added as whole
numbers of cents, which is exact as well; all others are added as decimals.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 8
# Sums of cents stay in 63 bits for 90 billion amounts of a key, or 900 million weighted ones.
SMALL = 1e6
LIGHT = 100


def units(amount: Column, places: int = PLACES) -> Column:
    """The amount as a decimal of so many places, for sums of up to 38 digits."""
    return amount.cast(f"decimal(28,{places})")


def _cents(amount: Column) -> tuple[Column, Column]:
    """Whether an amount is a small number of whole cents, and that number."""
    whole = F.rint(amount.cast("double") * 100)
    return (F.abs(amount) < SMALL) & (whole / 100 == amount), whole.cast("bigint")


def _total(cents: Column, rest: Column) -> Column:
    """Sum of a sum of cents and a decimal one, of which either may be missing; exact until it is made a double."""
    amount = cents.cast("decimal(28,0)") * F.lit(Decimal("0.01"))
    both = amount + rest.cast(f"decimal(37,{PLACES})")
    return F.when(cents.isNull(), rest.cast("double")).when(rest.isNull(), amount.cast("double")).otherwise(both.cast("double"))


def exact_sum(amount: Column, places: int = PLACES) -> Column:
    if places < 2:
        return F.sum(units(amount, places)).cast("double")
    small, cents = _cents(amount)
    return _total(F.sum(F.when(small, cents)), F.sum(F.when(~small, units(amount, places))))


def exact_avg(amount: Column, places: int = PLACES) -> Column:
    """Mean of the non-null amounts."""
    return exact_sum(amount, places) / F.nullif(F.count(amount), F.lit(0))


def weighted_avg(amount: Column, weight: Column, places: int = PLACES) -> Column:
    parts = amount.cast(f"decimal(23,{places})") * weight.cast("decimal(14,0)")
    small, cents = _cents(amount)
    light = F.coalesce(small & (weight >= 0) & (weight < LIGHT) & (weight == F.floor(weight)) & F.lit(places >= 2), F.lit(False))
    total = _total(F.sum(F.when(light, cents * weight.cast("bigint"))), F.sum(F.when(~light, parts)))
    return total / F.nullif(F.sum(F.when(amount.isNotNull(), weight)), F.lit(0))
