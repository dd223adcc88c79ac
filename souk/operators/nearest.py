"""Nearest vectors by cosine: random-hyperplane buckets find candidates, exact dot products rank them.

A vector is a set of (dimension, weight) rows, so nothing is spent on zeros.
Equal vectors are one class from the start: they are each other's nearest, and
however many there are, a class is hashed and compared once.  The result of a
class is one short list; its vectors are joined to it, split where a class is
hot, and drop themselves from it.

A hyperplane has +1 or -1 in each dimension, by a hash of the dimension; 64 of
them are the bits of one number.  A bucket is some of these bits.  A bucket
with too many classes is split by as many more bits as bring it down to size;
other tables make up for what that parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from souk.operators.joins import split_join
from souk.sources.store import Store

CAP = 256  # classes of a bucket that are compared with each other


def entries(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, dim, w of the non-zero entries of arrays of numbers; nulls and non-finite entries count as zero."""
    rows = vectors.select(F.col(key).alias("id"), F.posexplode(vector).alias("dim", "w"))
    w = F.col("w").cast("double")
    return rows.select("id", "dim", w.alias("w")).where(w.isNotNull() & (F.abs(w) > 0) & (F.abs(w) < float("inf")))


def classes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Of (id, dim, w): each id with its class, and each class with its first k + 1 ids.

    A class is named by a hash of 128 bits of its entries.
    """
    one = rows.groupBy("id").agg(*[F.bit_xor(F.xxhash64("dim", "w", F.lit(s))).alias(f"x{s}") for s in (1, 2)])
    named = one.select("id", F.concat(F.hex("x1"), F.lit("-"), F.hex("x2")).alias("class"))
    place = F.row_number().over(W.partitionBy("class").orderBy("id"))
    first = named.withColumn("place", place).where(F.col("place") <= k + 1)  # cut down before the shuffle, too
    return named, first.groupBy("class").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def planes(rows: DataFrame, numbers: int) -> DataFrame:
    """class and `bits`: for each number its 64 signs of the class's projections."""
    sums = [
        F.sum(F.when(F.shiftright(F.col(f"h{n}"), b).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(-F.col("w"))).alias(f"s{n}_{b}")
        for n in range(numbers)
        for b in range(64)
    ]
    signs = rows.withColumns({f"h{n}": F.xxhash64("dim", F.lit(f"plane {n}")) for n in range(numbers)}).groupBy("class").agg(*sums)

    def number(n: int) -> Column:
        out = F.lit(0).cast("bigint")
        for b in range(64):
            bit = (1 << b) - (1 << 64 if b == 63 else 0)
            out = out.bitwiseOR(F.when(F.col(f"s{n}_{b}") > 0, F.lit(bit)).otherwise(F.lit(0)).cast("bigint"))
        return out

    return signs.select("class", F.array(*[number(n) for n in range(numbers)]).alias("bits"))


def buckets(signed: DataFrame, tables: int, bits: int, cap: int = CAP) -> DataFrame:
    """class, bucket: of each table the class's bucket, cut finer where it has more than `cap` classes."""
    per = 64 // (2 * bits)  # tables of one number: half of a table's bits are kept for splitting
    cells = [
        F.struct(
            F.lit(t).alias("table"),
            F.shiftrightunsigned(F.get("bits", t // per), 2 * bits * (t % per)).bitwiseAND(F.lit((1 << 2 * bits) - 1)).alias("wide"),
        )
        for t in range(tables)
    ]
    rows = signed.select("class", F.inline(F.array(*cells)))
    rows = rows.withColumn("narrow", F.col("wide").bitwiseAND(F.lit((1 << bits) - 1)))
    sizes = rows.groupBy("table", "narrow").count().where(F.col("count") > cap)
    more = F.least(F.lit(bits), F.ceil(F.log2(F.col("count") / cap))).cast("int")
    hot = sizes.select("table", "narrow", more.alias("more"))
    wider = F.col("wide").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.lit(bits) + F.col("more")) - 1)
    split = rows.join(hot, ["table", "narrow"], "left")
    return split.select("class", F.concat_ws("-", "table", F.coalesce("more", F.lit(0)), F.when(F.col("more") > 0, wider).otherwise(F.col("narrow"))).alias("bucket"))


def _scored(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b, similarity of pairs of classes: exact, on eight decimals."""
    left, right = (rows.select(F.col("class").alias(c), "dim", F.col("w").alias(f"w{c}")) for c in ("a", "b"))
    dots = pairs.join(left, "a").join(right, ["b", "dim"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return _cosines(dots, rows)


def _cosines(dots: DataFrame, rows: DataFrame) -> DataFrame:
    norms = rows.groupBy("class").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    both = dots.join(norms.toDF("a", "na"), "a").join(norms.toDF("b", "nb"), "b")
    return both.select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 8).alias("similarity"))


def sharing(rows: DataFrame) -> DataFrame:
    """All pairs of classes that have a dimension in common, scored: exact for vectors without negative entries.

    For vectors of few dimensions each, such as texts; a dimension that very many
    different classes have costs the square of their number, which buckets avoid.
    """
    left, right = (rows.select(F.col("class").alias(c), "dim", F.col("w").alias(f"w{c}")) for c in ("a", "b"))
    dots = left.join(right, "dim").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return _cosines(dots, rows)


def bucketed(rows: DataFrame, tables: int, bits: int, cap: int = CAP) -> DataFrame:
    """Pairs of classes that share a bucket, scored."""
    met = buckets(planes(rows, -(-tables // (64 // (2 * bits)))), tables, bits, cap)
    pairs = met.toDF("a", "bucket").join(met.toDF("b", "bucket"), "bucket").where("a < b").select("a", "b").distinct()
    scored = _scored(pairs, rows)
    return scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))


def nearest(rows: DataFrame, store: Store, k: int = 5, exact: bool = False, tables: int = 24, bits: int = 5, cap: int = CAP, least: float = 0.0) -> DataFrame:
    """id, place (1 to k), neighbour, similarity: the k nearest others of each id in (id, dim, w).

    Similarities of ``least`` or less are no neighbours.  Ties go to the smaller
    id.  Ids without entries are in no result.  ``exact`` compares all classes
    that share a dimension instead of a bucket.
    """
    rows = store.replace("_nearest/rows", rows)
    named, ids = (store.replace(f"_nearest/{n}", df) for n, df in zip(("named", "ids"), classes(rows, k), strict=True))
    of_class = rows.join(ids.select("class", F.get("ids", 0).alias("id")), "id").select("class", "dim", "w")
    of_class = store.replace("_nearest/entries", of_class)
    pairs = sharing(of_class) if exact else bucketed(of_class, tables, bits, cap)
    # A class fills at least one place, so k + 1 classes are enough; the class itself has similarity 1.
    best = pairs.where(F.col("similarity") > least).join(ids.select(F.col("class").alias("b"), F.get("ids", 0).alias("first")), "b")
    place = F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "first"))
    best = best.withColumn("place", place).where(F.col("place") <= k + 1).select("a", "b", "similarity")
    own = ids.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity"))
    found = best.unionByName(own).join(ids.toDF("b", "ids"), "b").select("a", "similarity", F.explode("ids").alias("neighbour"))
    order = F.struct((-F.col("similarity")).alias("far"), "neighbour")
    lists = found.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(order)), 1, k + 1).alias("list"))
    each = split_join(named, lists.withColumnRenamed("a", "class"), "class", spread="id")
    others = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("id")), 1, k)
    out = each.select("id", F.posexplode(others).alias("at", "x"))
    return out.select("id", (F.col("at") + 1).cast("bigint").alias("place"), F.col("x.neighbour").alias("neighbour"), (-F.col("x.far")).alias("similarity"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """ids, neighbours and how many of these are found: as similar as the exact neighbour of the same place."""
    right = found.select("id", "place", F.col("similarity").alias("got"))
    hits = F.count_if(F.col("got") >= F.col("similarity"))
    return exact.join(right, ["id", "place"], "left").agg(F.count_distinct("id").alias("ids"), F.count("*").alias("neighbours"), hits.alias("found"))
