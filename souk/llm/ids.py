"""Rows whose id is in a list that is too long to be sent to every task as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.store import stored

RANGES = 4096  # bitmaps of 4 kB that may be sent to every task, 16 MB in all


def among(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key, a whole number, occurs in ids; null keys go, repeated rows stay.

    Ids become bitmaps of 32,768 neighbouring numbers, a bit for each, which are sent to every task: the rows are
    not shuffled. Ids that lie so far apart that they fill more than RANGES bitmaps are joined instead.
    """
    known = ids.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"))
    placed = known.select(F.bitmap_bucket_number("id").alias("_range"), F.bitmap_bit_position("id").alias("bit"))
    # Ids travel, not a bitmap of each task and range.
    bits = stored(placed.repartition("_range").groupBy("_range").agg(F.bitmap_construct_agg("bit").alias("_bits")))
    if bits.limit(RANGES + 1).count() > RANGES:
        return rows.join(ids.select(key), key, "left_semi")
    own = F.col(key).cast("bigint")
    bit = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substr(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(own) == F.col("_range"))
    return found.where(F.getbit(byte.cast("bigint"), (bit % 8).cast("int")) == 1).select(*rows.columns)
