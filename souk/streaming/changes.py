"""The append-only change stream of order events and its sinks."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from souk.operators.joins import not_in
from souk.operators.ranks import Asc, global_row_number
from souk.sources.schemas import ORDER_EVENTS
from souk.sources.store import Store, with_defaults

AVAILABLE_NOW = "available"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New event files of ``folder``; offsets live in the query's checkpoint."""
    reader = spark.readStream.schema(ORDER_EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str = AVAILABLE_NOW,
    into: tuple[Store, str] | None = None,
) -> StreamingQuery:
    """Start a query whose micro-batches go to ``handle``; empty ones are skipped.

    With ``into``, a store and a table, batches are numbered so that a query
    with a new checkpoint does not overwrite what an earlier one appended.
    A batch is worked out once, whatever ``handle`` does with it.

    ``every`` is either ``available`` (take what is there, then stop: an
    outside scheduler starts the next run) or an interval such as
    ``5 minutes`` for a standing query with that freshness.
    """

    def gated(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        try:
            if not held.isEmpty():
                handle(held, into[0].batch_number(into[1], query_id(batch), epoch) if into else epoch)
        finally:
            held.unpersist()

    def query_id(batch: DataFrame) -> str:
        return json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]

    writer = stream.writeStream.foreachBatch(gated).outputMode(mode).option(
        "checkpointLocation", checkpoint
    )
    if every == AVAILABLE_NOW:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    return writer.trigger(processingTime=every).start()


def into_table(store: Store, name: str) -> Callable[[DataFrame, int], None]:
    """Sink that appends every batch once (a repeated batch rewrites its folder)."""
    return lambda batch, epoch: store.append(name, batch, epoch)


def _newest(store: Store, name: str, keys: list[str]) -> DataFrame:
    """Newest row per key with its epoch: compacted rows plus later batches."""
    packed, parts, done = f"_compact/{name}", [], -1
    if store.exists(packed):
        parts.append(store.read(packed))
        done = parts[0].agg(F.max("epoch")).first()[0]
    later = [store.path(name, f"epoch={e}") for e in store.epochs(name) if e > done]
    if later:
        reader = store.spark.read.option("basePath", store.path(name))
        parts.append(reader.parquet(*later).withColumn("epoch", F.col("epoch").cast("long")))
    rows = reduce(DataFrame.unionByName, parts)
    values = [c for c in rows.columns if c not in (*keys, "epoch")]
    newest = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "epoch").alias("row"), F.max("epoch").alias("epoch")
    )
    return newest.select(*keys, "row.*", "epoch")


def latest_rows(store: Store, name: str, keys: list[str]) -> DataFrame:
    """Newest row per key of a table that receives updated rows batch by batch."""
    return _newest(store, name, keys).drop("epoch")


def compact(store: Store, name: str, keys: list[str]) -> None:
    """Fold all batches so far into one version; readers then skip them."""
    store.replace(f"_compact/{name}", _newest(store, name, keys))


def land(batch: DataFrame, store: Store, name: str, epoch: int, now: str) -> DataFrame:
    """Give arriving events their id and arrival time, fill defaults and append them.

    Ids continue after the highest id landed by earlier batches, so running
    the same batch again assigns the same range.
    """
    filled = with_defaults(
        batch,
        {
            "event_timestamp": F.lit(now).cast("timestamp_ntz"),
            "is_returned": F.lit(False),
            "is_cancelled": F.lit(False),
        },
    )
    earlier = store.read_before(name, epoch, ORDER_EVENTS)
    last = earlier.agg(F.coalesce(F.max("event_id"), F.lit(0))).scalar()
    order = [Asc(f.name) for f in ORDER_EVENTS.fields if f.name != "event_id"]
    numbered = global_row_number(filled, order, store, f"land-{name}-{epoch}", out="place")
    rows = numbered.withColumn("event_id", last + F.col("place"))
    typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in ORDER_EVENTS.fields])
    store.append(name, typed, epoch)
    return typed


def has_new_data(landing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Probe: highest landed and merged ids, and whether something is waiting."""
    top = lambda df: df.agg(F.coalesce(F.max("event_id"), F.lit(-1))).scalar()
    seen = landing.agg(F.coalesce(F.max("event_id"), F.lit(-1)).alias("landed"))
    waiting = not_in(landing, ledger, "event_id").limit(1).agg(F.count("*") > 0).scalar()
    return seen.withColumn("merged", top(ledger)).withColumn("has_new_data", waiting)
