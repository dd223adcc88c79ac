"""Sellers from raw text rows that each hold a JSON array of seller objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.sources.schemas import SELLERS


def ingest_sellers(raw: DataFrame, column: str = "json_data") -> DataFrame:
    """One row per array element; malformed text gives no row.

    Every field is parsed as text and cast with ``try_cast``, so one badly
    typed field becomes null instead of failing or dropping the whole object.
    """
    as_text = T.ArrayType(
        T.StructType([T.StructField(f.name, T.StringType()) for f in SELLERS.fields])
    )
    items = raw.select(F.explode(F.from_json(F.col(column), as_text)).alias("item"))
    fields = [
        F.col(f"item.{f.name}").try_cast(f.dataType).alias(f.name) for f in SELLERS.fields
    ]
    return items.filter(F.col("item").isNotNull()).select(*fields)
