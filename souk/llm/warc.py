"""WARC archives: one record per page, read back in parallel with verified record boundaries.

A page whose payload (of `least` bytes or more) equals that of a page with a smaller id becomes a
revisit record that refers to the smallest one; all others are responses with their payload.

Readers take byte ranges of the files and cut them wherever a line begins like a record. That may be
inside a payload. Each cut after two line ends is a candidate with the offset its own header gives for
its successor.
A record is real if the chain of successors from the start of its file reaches it: neighbours that
point to each other are joined to runs, and pointer jumping over the runs finds those that the
start reaches. The other cuts are parts of the payload they lie in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from souk.llm.store import stored

END = "\r\n\r\n"
MAGIC = "WARC/1."
CUT = "\n" + MAGIC  # its first byte occurs nowhere else in it, so a line reader that cannot step back over its buffer's edge finds each
LONGEST = 1 << 20  # bytes of a header
FEW = 100_000  # rows of a table that may be sent to every task; larger ones are shuffled
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _small(df: DataFrame) -> DataFrame:
    """df for a join: broadcast if it has few rows, as counted, else left to a shuffle."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def write_warc(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the archives, a file for each task.

    Null payloads count as empty. A null key has an empty id, comes after all others, and never
    serves as a revisit's target unless all its equals have none. Rows of the smallest id of equal
    payloads are all responses. A null address is left out, line ends in one are dropped. Other
    columns are not written.
    """
    own = pages.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    own = own.withColumn("bytes", F.octet_length("payload")).withColumn("digest", F.sha2("payload", 256))
    long = own.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("same")).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    own = own.join(_small(stored(long)), (F.col("digest") == F.col("same")) & (F.col("bytes") >= least), "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    body = F.when(again, F.lit("")).otherwise(F.col("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(c.cast("string")), F.lit("")), F.lit(">"))
    header = F.concat_ws(
        "\r\n",
        F.lit(f"{MAGIC}1"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("key"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("uri", "[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, line("WARC-Refers-To", urn(F.col("first")))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html"),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Length", F.octet_length(body).cast("string")),
    )
    own.select(F.concat(header, F.lit(END), body).alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two lines that begin like a record, in the order of the file within a split."""
    raw = spark.read.option("lineSep", CUT).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _header(value: Column) -> Column:
    """The header that a piece begins with, if any. Where a payload begins like a record, the cut takes the last byte of the header's end."""
    ended = F.when(value.contains(END), value).when(value.endswith(END[:-1]) & (F.octet_length(value) < LONGEST), F.concat(value, F.lit(END[-1])))
    return F.when(F.substring(value, 1, 10).rlike(r"^(WARC/1\.)?[01]\r\n"), F.substring_index(ended, END, 1))


def _place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds at: the bytes of the split before each piece, cuts included."""
    now, at = None, 0
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        sizes = batch.column("len").to_pylist()
        out = np.empty(batch.num_rows, np.int64)
        for i, (split, size) in enumerate(zip(zip(files, blocks, strict=True), sizes, strict=True)):
            if split != now:
                now, at = split, 0
            out[i] = at
            at += size + len(CUT)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "at"])


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at, off, next (offset of the successor by the header; null without one or if no END stands before), whole."""
    value = F.col("value")
    found = _pieces(spark, path).select("file", "block", F.octet_length(value).cast("bigint").alias("len"), value.endswith(END[:-1]).alias("ends"), _header(value).alias("header"))
    length = F.regexp_extract("header", r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", 1)
    need = F.octet_length("header") + 4 + F.when(length != "", length.cast("bigint"))
    found = found.select("file", "block", "len", "ends", need.alias("need")).mapInArrow(_place, "file string, block bigint, len bigint, ends boolean, need bigint, at bigint")
    found = stored(found)
    splits = found.groupBy("file", "block").agg(F.sum(F.col("len") + len(CUT)).alias("bytes"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    begin = F.col("base") + F.col("at")
    after = (begin == 0) | F.lag("ends").over(W.partitionBy("file").orderBy("off"))
    placed = found.join(splits, ["file", "block"]).withColumn("off", F.when(begin == 0, 0).otherwise(begin - len(MAGIC)))
    return placed.select("file", "block", "at", "off", F.when(after, begin + F.col("need") + len(END)).alias("next"), (F.col("need") <= F.col("len")).alias("whole"))


def _reached(candidates: DataFrame) -> DataFrame:
    """The candidates with real: whether the chain from the start of the file reaches them."""
    order = W.partitionBy("file").orderBy("off")
    linked = candidates.withColumn("linked", F.coalesce(F.col("next") == F.lead("off").over(order), F.lit(False)))
    runs = stored(linked.withColumn("run", F.coalesce(F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    exits = runs.where(~F.col("linked") & F.col("next").isNotNull()).select("file", "run", F.col("next").alias("entry"))
    jump = stored(exits.join(runs.select("file", F.col("off").alias("entry"), F.col("run").alias("to")), ["file", "entry"]).select("file", "run", "to", "entry"))
    reach = runs.where("off = 0").select("file", "run", F.col("off").alias("entry"))
    longest = jump.groupBy("file").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    steps = 1
    while steps <= longest:  # runs of the chain that are known double with each step
        onward = reach.drop("entry").join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        reach = stored(reach.unionByName(onward))
        far = jump.select("file", F.col("run").alias("to"), F.col("to").alias("far"), F.col("entry").alias("there"))
        jump = stored(jump.drop("entry").join(far, ["file", "to"]).select("file", "run", F.col("far").alias("to"), F.col("there").alias("entry")))
        steps *= 2
    reach = reach.withColumnRenamed("entry", "entered")
    real = F.col("entered").isNotNull() & (F.col("off") >= F.col("entered")) & F.col("next").isNotNull()
    return runs.join(reach, ["file", "run"], "left").withColumn("real", real).drop("run", "entered", "linked")


def _field(name: str) -> Column:
    value = F.regexp_extract("header", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(value != "", value)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record_type, record_id, refers_to, target_uri, digest, length, header, payload.

    length is the full payload's, by the header. Records that a file's chain does not reach, because
    it is broken before them, and records cut off by the end of a file are left out. A file's header
    facts (a few dozen bytes for each record) are put in order in one task; payloads are not moved,
    but for those that hold possible record starts.
    """
    verdict = _reached(_candidates(spark, path))
    owner = F.last(F.when(F.col("real"), F.struct("off", "whole", "next")), ignorenulls=True).over(W.partitionBy("file").orderBy("off").rowsBetween(W.unboundedPreceding, 0))
    odd = verdict.withColumn("owner", owner).where(~F.coalesce(F.col("real") & F.col("whole"), F.lit(False)))
    odd = stored(odd.select("file", "block", "at", "off", F.when(~F.col("owner.whole") & (F.col("off") < F.col("owner.next")), F.col("owner.off")).alias("owner"), F.lit(True).alias("odd")))
    pieces = _pieces(spark, path).withColumn("len", F.octet_length("value").cast("bigint")).withColumn("value", F.col("value").cast("binary"))
    pieces = pieces.mapInArrow(_place, "file string, block bigint, value binary, len bigint, at bigint").drop("len")
    pieces = pieces.join(_small(odd), ["file", "block", "at"], "left")
    plain = pieces.where(F.col("odd").isNull()).select("value")
    if not odd.isEmpty():
        parts = pieces.where(F.col("owner").isNotNull()).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("off", "value"))).alias("parts"))
        cut = F.lit(CUT).cast("binary")
        joined = F.aggregate("parts", F.lit(None).cast("binary"), lambda all_, x: F.when(all_.isNull(), x["value"]).otherwise(F.concat(all_, cut, x["value"])))
        plain = plain.unionByName(parts.select(joined.alias("value")))
    rows = plain.withColumn("header", F.substring_index(F.col("value").cast("string"), END, 1))
    begin, size = F.octet_length("header") + 5, _field("Content-Length").cast("int")
    rows = rows.where(F.octet_length("value") >= begin - 1 + size)
    urn = lambda name: F.url_decode(F.regexp_extract(_field(name), "<urn:page:(.*)>", 1))
    return rows.select(_field("WARC-Type").alias("record_type"), urn("WARC-Record-ID").alias("record_id"), urn("WARC-Refers-To").alias("refers_to"), _field("WARC-Target-URI").alias("target_uri"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"), _field("X-Payload-Length").cast("bigint").alias("length"), "header", F.substring(F.col("value"), begin, size).alias("payload"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 h AS (SELECT page_id, strlen(html)::BIGINT AS n, sha256(html) AS digest FROM p),
 f AS (SELECT digest, min(page_id) AS first FROM h WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, h.digest AS payload_digest,
 CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id > first THEN first END AS refers_to
FROM h LEFT JOIN f ON h.digest = f.digest AND n >= 100
"""
