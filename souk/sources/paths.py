"""Fields by path from JSON of unknown shape, kept as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_items(raw: DataFrame, column: str) -> DataFrame:
    """item (variant): each element of an array, or the value itself, of every row.

    Text is parsed once. Malformed or null text and empty arrays give no row; null elements are JSON nulls.
    """
    parsed = raw.select(F.try_parse_json(F.col(column)).alias("value")).where("value IS NOT NULL")
    elements = F.try_variant_get("value", "$", "array<variant>")
    return parsed.select(F.explode(F.coalesce(elements, F.array("value"))).alias("item"))


def at_path(item: Column, path: str, kind: str) -> Column:
    """The value at a path such as ``$.a.b[2]``; null where there is none or it is of another type."""
    return F.try_variant_get(item, path, kind)


def fields(items: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """A column for each name, of the (path, type) given."""
    return items.select(*[at_path(F.col("item"), path, kind).alias(name) for name, (path, kind) in wanted.items()])
