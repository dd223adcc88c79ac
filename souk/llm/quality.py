"""Quality rules and a hashed n-gram log-likelihood ratio, with DataFrame operations alone.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two multinomials
over the buckets are counted: of trusted target documents and of the whole raw corpus. A document's
score is the mean of log(target / raw) over its n-grams, so length does not matter; documents that
fail a base rule or score under the threshold are not kept. The threshold is taken from the scores of
trusted documents that the ratios are not fitted on. Ratios are whole millionths, so sums
do not depend on the order of addition.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.columns import let
from souk.llm.store import slices, stored

BUCKETS = 1 << 14
HELD = 5  # one in so many trusted texts is not fitted on but sets the threshold
LOW = 0.01  # quantile of their scores; the threshold is as far below it as it is below their median
UNIT = 1_000_000
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _repeats(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; windows are told apart by 64-bit hashes."""

    def covered(at: Column) -> Column:  # sorted first words of such windows
        gaps = F.zip_with(F.slice(at, F.lit(2), F.size(at) - 1), F.slice(at, F.lit(1), F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(3)))
        return F.aggregate(gaps, F.lit(3), lambda x, y: x + y)

    def twins(s: Column) -> Column:  # windows as (hash, place), sorted: twins are neighbours
        n = F.size(s)
        near = F.transform(s, lambda x, i: F.when(((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"])), x["i"]))
        return F.sort_array(F.filter(near, lambda x: x.isNotNull()))

    def some(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda s: let(twins(s), covered)))

    n = F.size(ws)
    hashes = F.transform(F.slice(ws, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(let(hashes, some)).cast("bigint")


def base_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, same (hash of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed for each row.

    Null and empty texts have zeros and fail. Repeated rows each get a row, null keys are kept.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("words", words(F.col("text"))).withColumn("lines", lines)
    without = lambda chars: F.length(F.translate("text", chars, ""))
    rows = rows.select("key", F.xxhash64("text").alias("same"), F.size("words").cast("bigint").alias("n_words"), without(SPACES).cast("bigint").alias("word_chars"), (F.length("text") - without(SYMBOLS)).cast("bigint").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), _repeats(F.col("words")).alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ngrams(rows: DataFrame, buckets: int) -> DataFrame:
    """A row for each word: the buckets of the word and of its pair with the next (null for the last)."""
    ws = F.col("words")
    rows = rows.withColumn("words", words(F.col("text")))
    rows = rows.withColumn("gram", F.explode(F.arrays_zip(ws.alias("w"), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))).alias("after"))))
    one = F.pmod(F.xxhash64(F.col("gram.w")), F.lit(buckets))
    two = F.when(F.col("gram.after").isNotNull(), F.pmod(F.xxhash64(F.col("gram.w"), F.col("gram.after")), F.lit(buckets)))
    return rows.withColumn("one", one).withColumn("two", two).drop("gram", "words", "text")


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often the n-grams of all texts fall into each bucket."""
    grams = _ngrams(docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), buckets)
    both = grams.select(F.explode(F.array("one", "two")).alias("bucket")).where("bucket is not null")
    return both.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def ratios(target: DataFrame, raw: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """Millionths of log(target / raw) for each bucket, both smoothed by one; all 0 without target n-grams.

    What comes to the driver is one number for each bucket, whatever the data.
    """
    both = bucket_counts(raw, text, buckets).withColumnRenamed("n", "raw").join(bucket_counts(target, text, buckets).withColumnRenamed("n", "target"), "bucket", "left").fillna(0)
    whole = F.col("all_target") > 0
    sums = both.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"), F.collect_list(F.struct("bucket", "raw", "target")).alias("each"))
    ratio = F.ln((F.col("x.target") + 1) / (F.col("all_target") + buckets) * (F.col("all_raw") + buckets) / (F.col("x.raw") + 1))
    rows = sums.select("all_raw", "all_target", F.explode("each").alias("x")).select("x.bucket", F.when(whole, F.round(ratio * UNIT).cast("bigint")).otherwise(0)).collect()
    found = dict(rows)
    return [found.get(i, 0) for i in range(buckets)]


def scores(docs: DataFrame, table: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, same (hash of the text), score: the mean ratio of all n-grams; no row for texts without words."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    grams = _ngrams(rows.withColumn("same", F.xxhash64("text")), len(table))
    known = F.from_json(F.lit(json.dumps(table)), "array<bigint>")
    of = lambda c: F.get(known, F.col(c).cast("int"))
    sums = grams.groupBy("key", "same").agg(F.sum(of("one") + F.coalesce(of("two"), F.lit(0))).alias("total"), (F.count("one") + F.count("two")).alias("n"))
    return sums.select("key", "same", (F.col("total") / F.col("n") / UNIT).alias("score"))


def fence(trusted: DataFrame, table: list[int], key: str = "doc_id", text: str = "text") -> float:
    """The threshold by the scores of trusted texts that pass the base rules: twice their LOW quantile less their median.

    Without such texts it is minus infinity, so no score fails.
    """
    trusted = stored(trusted.select(key, text))
    rules = stored(base_rules(trusted, key, text).select(F.col("key").alias("_key"), F.col("same").alias("_same"), "base_failed"))  # else the filter repeats the rules
    rules = rules.where(~F.col("base_failed"))
    found = scores(trusted, table, key, text).join(rules, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_same") == F.col("same")), "left_semi")
    low, middle = quantiles(found, "score", [LOW, 0.5])
    return float("-inf") if low is None else 2 * low - middle


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of all known values, between two neighbours by their distance, as F.percentile has them.

    That holds all values in one task; here they are sorted in ranges, of which the driver gets the sizes.
    """
    known = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    place = F.monotonically_increasing_id()  # the range in the upper bits, the place within it in the lower 33
    ranges = known.repartitionByRange(slices(rows.sparkSession), "v").sortWithinPartitions("v")
    placed = stored(ranges.withColumn("at", place))
    sizes = sorted(placed.groupBy(F.shiftright("at", 33).alias("range")).count().collect())
    n = sum(size for _, size in sizes)
    if not n:
        return [None] * len(shares)

    def at(number: int) -> int:
        for part, size in sizes:
            if number < size:
                return (part << 33) + number
            number -= size

    spots = [(n - 1) * s for s in shares]
    wanted = {i: at(i) for x in spots for i in (math.floor(x), math.ceil(x))}
    value = dict(placed.where(F.col("at").isin(list(wanted.values()))).select("at", "v").collect())
    found = []
    for x in spots:
        i, j = math.floor(x), math.ceil(x)
        a, b = value[wanted[i]], value[wanted[j]]
        found.append(a if a == b else (j - x) * a + (x - i) * b)
    return found


def quality(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, threshold: float | None = None) -> DataFrame:
    """base_rules() with score and kept for each row; target holds the trusted texts, any number, in columns of the same names.

    kept is false if base_failed, else whether the score reaches the threshold. Without a given one
    the ratios are fitted on all but one in HELD of the trusted texts, chosen by a hash of the text,
    and these set it by fence(). Without target texts all scores are 0. A text without words has no
    score and is not kept.
    """
    if threshold is None:
        held = F.pmod(F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("threshold")), F.lit(HELD)) == 0
        table = ratios(target.where(~held), docs, text, buckets)
        threshold = fence(target.where(held), table, key, text)
    else:
        table = ratios(target, docs, text, buckets)
    rules = base_rules(docs, key, text)
    found = scores(docs, table, key, text).withColumnsRenamed({"key": "_key", "same": "_same"})
    out = rules.join(found, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_same") == F.col("same")), "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    return out.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", kept.alias("kept"))
