"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations alone.

Every source's documents stand in a shuffled queue (by the MD5 of key and seed), which may run
through up to `passes` times. A document's virtual finish time is the words of its source up to and
with it, divided by the source's target. All queues are sorted by finish time together and cut off
where the total budget is used up, so at any moment each source has got its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from souk.llm.columns import renamed, restored
from souk.llm.store import slices, stored

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def running_total(df: DataFrame, value: str, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Adds `running`: the sum of value over the rows of the group up to this one.

    The rows are cut into slices of the sorted order and summed by slice first, so a group may hold
    any share of them. Rows that tie in all of group and order share an undefined order.
    """
    cut = stored(df.repartitionByRange(slices(df.sparkSession), *group, *order).withColumn("_slice", F.spark_partition_id()))
    sums = cut.groupBy("_slice", *group).agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_slice", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    own = W.partitionBy("_slice", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return cut.join(sums, ["_slice", *group]).withColumn("running", F.col("_before") + F.sum(value).over(own)).drop("_slice", "_before")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, passes: int = 3) -> DataFrame:
    """From (source, size): source, rank, source_size, target.

    Sources by code point, null last, take the weights in turn. A source gets weight times the water
    level, at most `passes` times its size; the level is where all targets add up to all sizes. One
    row for each source is sorted in one task.
    """
    whole = W.partitionBy()
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    totals = totals.withColumn("weight", of).withColumn("limit", F.col("source_size") * passes)
    totals = totals.withColumn("full_at", F.col("limit") / F.col("weight"))
    before = W.orderBy("full_at", "rank").rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = totals.withColumn("level", rest / share)
    level = F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank"))).over(whole)
    levels = levels.withColumn("level", level)
    return levels.select("source", "rank", "source_size", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, passes: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: key, source, size (words), source_size, target, times (0 to passes), taken.

    The budget is the sum of all sizes. Null texts and texts without words have size 0 and take
    nothing. A null source is a source of its own, after all others. Rows with equal key, source and
    size queue as one and are taken equally often. No rows in, no rows out. Other columns are not read.
    """
    sizes = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    return _times(sizes, weights, passes, seed).select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, passes: int = 3, seed: str = "mix") -> DataFrame:
    """The documents themselves, all columns, each as often as mix() takes it.

    Documents without words, null and empty texts too, take nothing and so go; a null source mixes like
    any other, null keys and repeated rows queue as mix() says. An empty table gives no rows. Columns of
    any name are handed on unchanged.
    """
    own, names = renamed(docs)
    key, text, source = names[key], names[text], names[source]
    own = own.withColumn("words", word_count(F.col(text)))
    sizes = stored(own.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col("words").alias("size")))
    taken = _times(sizes, weights, passes, seed).where("times > 0").select("key", "source", "size", "times").distinct()
    same = F.col(key).eqNullSafe(F.col("key")) & F.col(source).eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    return restored(own.join(taken, same).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))), names)


def _times(sizes: DataFrame, weights: Sequence[float], passes: int, seed: str) -> DataFrame:
    targets = source_targets(sizes, weights, passes).withColumnRenamed("source", "_source")
    units = sizes.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = units.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    units = units.withColumn("words", F.col("size") * F.col("rows"))
    units = units.withColumn("tie", F.md5(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(f":{seed}"))))
    queue = stored(running_total(units, "words", ("tie", "key", "size"), ("rank",)))
    finish = (F.col("running") + F.col("pass") * F.col("source_size")) / F.col("target")
    all_passes = queue.where("words > 0").withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(passes)]))).select("rank", "words", "size", "tie", "key", "pass", finish.alias("finish"))
    order = ("finish", "tie", "rank", "size", "pass")
    budget = queue.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    last = running_total(all_passes, "words", order).where(F.col("running") <= budget).agg(F.max(F.struct(*order))).first()[0]
    place = lambda i: F.struct(((F.col("running") + i * F.col("source_size")) / F.col("target")).alias("finish"), F.col("tie"), F.col("rank"), F.col("size"), F.lit(i).alias("pass"))
    end = F.struct(*[F.lit(last[c]).alias(c) for c in order]) if last else None
    fits = [F.when((F.col("words") > 0) & (place(i) <= end), 1).otherwise(0) for i in range(passes)] if last else [F.lit(0)]
    times = sum(fits[1:], fits[0])
    return queue.withColumn("times", times.cast("int")).withColumn("_each", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).drop("_each")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source),
 w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
 f AS (SELECT *, 3 * source_size / weight AS full_at FROM w),
 l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce((sum(3 * source_size) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0))
   / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM f),
 v AS (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, rank LIMIT 1),
 t AS (SELECT source, rank, source_size, least((3 * source_size)::DOUBLE, (SELECT level FROM v) * weight) AS target FROM l),
 u AS (SELECT doc_id, source, size, count(*) AS n, size * count(*) AS words, md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS tie FROM d GROUP BY doc_id, source, size),
 q AS (SELECT u.*, t.rank, t.source_size, t.target, (sum(words) OVER (PARTITION BY t.rank ORDER BY tie, doc_id NULLS FIRST, size))::BIGINT AS running
   FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
 p AS (SELECT q.*, e.pass, (running + e.pass * source_size)::DOUBLE / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS pass) e WHERE words > 0),
 g AS (SELECT *, sum(words) OVER (ORDER BY finish, tie, rank, size, pass ROWS UNBOUNDED PRECEDING) AS total FROM p),
 k AS (SELECT doc_id, source, size, count(*) AS times FROM g WHERE total <= (SELECT sum(words) FROM q) GROUP BY doc_id, source, size)
SELECT d.doc_id, d.size, t.source_size, t.target, (d.size * coalesce(k.times, 0))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.source IS NOT DISTINCT FROM k.source AND d.size = k.size
"""
