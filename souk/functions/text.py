"""Text helpers: quoted label extraction, numbers as text, word-score sentiment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the first double-quoted part of a text.
QUOTED = '"([^"]+)"'

# Word scores of the segment labels, ours: -1 worst .. 1 best.
WORD_SCORES = {
    "top": 1.0,
    "good": 0.6,
    "average": 0.0,
    "needs": -0.6,
    "improvement": -0.4,
    "high": 0.8,
    "moderate": 0.4,
    "stable": 0.1,
    "declining": -0.8,
    "performer": 0.0,
    "growth": 0.2,
}


def quoted_label(text: Column) -> Column:
    """Quoted part of ``text``, null when there is none."""
    found = F.regexp_extract(text, QUOTED, 1)
    return F.when(found != "", found)


def sentiment(text: Column) -> Column:
    """Mean score of the known words in ``text``, in -1..1; 0 when none is known.

    Works inside the row (map lookup over the word array): no join, no shuffle.
    """
    lexicon = F.create_map(*[F.lit(x) for pair in WORD_SCORES.items() for x in pair])
    words = F.split(F.lower(text), "[^a-z]+")
    scores = F.filter(
        F.transform(words, lambda w: F.try_element_at(lexicon, w)), lambda s: s.isNotNull()
    )
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s)
    mean = total / F.nullif(F.size(scores), F.lit(0))
    return F.round(F.coalesce(mean, F.lit(0.0)), 3)
