"""Repeatable picks that replace random draws.

The value depends only on (key, salt): a re-run or a retried task gives the
same row again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salted_hash(key: Column, salt: str = "") -> Column:
    """Non-negative long from the first 32 bits of md5(key || salt)."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def salted_pick(key: Column, salt: str, n: int) -> Column:
    return salted_hash(key, salt) % F.lit(n)


def pick_from(key: Column, salt: str, options: list[str]) -> Column:
    """One of ``options`` by hash, via array index."""
    index = (salted_pick(key, salt, len(options)) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), index)
