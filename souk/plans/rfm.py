"""Recency / frequency / monetary scores and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.ladders import ladder
from souk.functions.text import quoted_label
from souk.operators.ranks import Asc, Desc, ntile_columns
from souk.sources.store import Store

KEY = "customer_id"


def rfm_base(gold: DataFrame, as_of: str) -> DataFrame:
    return gold.select(
        KEY,
        F.date_diff(F.lit(as_of).cast("date"), "last_order_date").alias("recency_days"),
        F.col("total_orders").alias("frequency"),
        F.col("total_order_value").alias("monetary_value"),
    )


def rfm_scores(base: DataFrame, store: Store, higher_is_better: bool = False) -> DataFrame:
    """Quintile scores and their sum; ties are ordered by customer id.

    r: 5 is the most recent fifth.  f and m: 1 is the highest fifth, as the
    modelled product computes it; ``higher_is_better=True`` turns them round.
    """
    measures = {"r": Asc("recency_days"), "f": Desc("frequency"), "m": Desc("monetary_value")}
    r, f, m = ntile_columns(base, 5, measures, KEY, store, "rfm").values()
    if higher_is_better:
        f, m = 6 - f, 6 - m
    scored = base.select(
        KEY, (6 - r).alias("r_score"), f.alias("f_score"), m.alias("m_score")
    )
    return scored.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))


# Segment rules; high is 4 or more, medium 3, very low 1 (cuts are ours).
RFM_SEGMENT = [
    ("Champion", [("r_score", ">=", 4), ("f_score", ">=", 4), ("m_score", ">=", 4)]),
    ("Cant Lose Them", [("r_score", "=", 1), ("f_score", ">=", 4)]),
    ("At Risk", [("r_score", "<=", 2), ("f_score", ">=", 4), ("m_score", ">=", 4)]),
    ("Potential Loyalist", [("r_score", ">=", 4), ("f_score", ">=", 3), ("m_score", ">=", 3)]),
    ("New Customer", [("r_score", ">=", 4), ("f_score", "<=", 2)]),
]
RFM_DEFAULT = [
    ("At Risk", [("r_score", "<=", 2)]),
]
RFM_OTHER = "Potential Loyalist"


def rfm_segments(scores: DataFrame) -> DataFrame:
    """Adds the segment as a quoted answer text plus the extracted label."""
    label = ladder([*RFM_SEGMENT, *RFM_DEFAULT], RFM_OTHER)
    answered = scores.withColumn("rfm_segment", F.concat(F.lit('"'), label, F.lit('"')))
    return answered.withColumn("extracted_value", quoted_label(F.col("rfm_segment")))
