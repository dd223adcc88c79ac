"""Tables in folders by hash of a key: single folders are read, and replaced, without the others.

``_bucket`` is a partition column, so a filter on it prunes folders before any
file is listed or opened.  How many buckets a table has is fixed when it is
first written; it bounds what the driver learns about a batch (the numbers of
the buckets it touches), however many keys the batch has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.sources.store import Store, freeing

BUCKETS = 256
BUCKET = "_bucket"


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    """Bucket of a key; null keys share one."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, key: str, buckets: int = BUCKETS) -> list[int]:
    """Numbers of the buckets that hold the rows' keys: at most ``buckets`` rows reach the driver."""
    return sorted(r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect())


class Bucketed:
    """A table in the store whose rows lie in folders by bucket of ``key``."""

    def __init__(self, store: Store, name: str, key: str, schema: T.StructType, buckets: int = BUCKETS):
        self.store, self.name, self.key, self.schema, self.buckets = store, name, key, schema, buckets

    def _write(self, df: DataFrame, path: str, dynamic: bool = False) -> None:
        """One file for each bucket, unless it is large: the rebalance splits and merges by bytes."""
        rows = df.select(*self.schema.names).withColumn(BUCKET, bucket_of(self.key, self.buckets))
        rows = rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, self.key)
        writer = rows.write.mode("overwrite").partitionBy(BUCKET)
        with freeing(df.sparkSession):
            writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(path)

    def _read(self, paths: list[str], only: list[int] | None, *parts: str) -> DataFrame:
        """Rows below some folders of the table; ``parts`` names the partition columns in the folders' own paths."""
        if not paths:
            return self.store.spark.createDataFrame([], self.schema)
        found = [T.StructField(name, T.IntegerType()) for name in (*parts, BUCKET)]
        reader = self.store.spark.read.schema(T.StructType([*self.schema.fields, *found]))
        if parts:
            reader = reader.option("basePath", self.store.path(self.name))
        rows = reader.parquet(*paths)
        if only is not None:
            rows = rows.where(F.col(BUCKET).isin(only))
        return rows.select(*self.schema.names)

    # -- one copy of each row ----------------------------------------------
    @property
    def path(self) -> str:
        return self.store.path(self.name, "buckets")

    def write(self, df: DataFrame) -> None:
        """Create or replace the whole table."""
        self._write(df, self.path)

    def replace(self, df: DataFrame, run: str) -> None:
        """Replace the buckets that ``df`` has rows for by these rows; all others keep their files.

        ``df`` may read this table: it is worked out into a folder of its own
        (``run``) first.  Doing it again, after a failure halfway as well,
        leaves the same buckets.
        """
        staged = self.store.replace(f"_staged/{self.name}/{run}", df)
        self._write(staged, self.path, dynamic=True)

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        return self._read([self.path], only)

    def lookup(self, value) -> DataFrame:
        """Rows of one key: one folder is opened, and row groups are skipped by the key within it."""
        like = self.store.spark.range(1).select(F.lit(value).cast(self.schema[self.key].dataType).alias(self.key))
        return self.read(touched(like, self.key, self.buckets)).where(F.col(self.key) == F.lit(value))

    # -- batches side by side ----------------------------------------------
    def append(self, df: DataFrame, epoch: int) -> None:
        """Add a batch; writing the same epoch again replaces that batch."""
        self._write(df, self.store.path(self.name, f"epoch={epoch}"))

    def read_batches(self, only: list[int] | None = None, without: int | None = None) -> DataFrame:
        """Rows of all committed batches, but for the one numbered ``without``."""
        epochs = [e for e in self.store.epochs(self.name) if e != without]
        return self._read([self.store.path(self.name, f"epoch={e}") for e in epochs], only, "epoch")
