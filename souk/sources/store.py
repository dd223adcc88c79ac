"""Parquet tables in one shared folder: versioned replace, epoch append, typed read.

Layout below the root::

    <table>/v=000003/      one complete version, readable once it has _SUCCESS
    <table>/epoch=17/      one appended batch; re-running batch 17 rewrites it

A reader takes the newest version that has a ``_SUCCESS`` marker, so it never
sees a half-written table, and old versions stay readable for running queries.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="souk-")
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


# Spark then deletes the shuffle files of a query as soon as it is through.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Queries run within leave no shuffle files: what they wrote is read from the store from then on.

    Else the files stay until the driver happens to collect its garbage, and a chain of stored
    tables fills the disk with all of its shuffles instead of those of one step.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Store:
    """A set of tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_root(spark)}/souk-{uuid.uuid4().hex}"

    # -- file system -----------------------------------------------------
    def path(self, *parts) -> str:
        return "/".join([self.root, *[str(p) for p in parts]])

    def _fs(self, path: str):
        jvm = self.spark._jvm
        jpath = jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _children(self, *parts) -> list[str]:
        fs, jpath = self._fs(self.path(*parts))
        if not fs.exists(jpath):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(jpath))

    def _complete(self, name: str, prefix: str) -> list[str]:
        """Sub-folders of a table whose write has been committed."""
        done = []
        for child in self._children(name):
            if child.startswith(prefix):
                fs, jpath = self._fs(self.path(name, child, "_SUCCESS"))
                if fs.exists(jpath):
                    done.append(child)
        return done

    # -- whole tables ----------------------------------------------------
    def exists(self, name: str) -> bool:
        return bool(self._complete(name, "v=") or self._complete(name, "epoch="))

    def replace(self, name: str, df: DataFrame, cluster_by: str | None = None) -> DataFrame:
        """Create or replace a table from a query and return the stored rows.

        ``df`` may read the current version of the same table.  With
        ``cluster_by`` rows of one key are stored together and in order: later
        aggregates by that key combine before their shuffle, and a lookup of
        one key skips most row groups.  The rebalance splits a partition that
        a hot key makes too large and merges small ones.
        """
        if cluster_by:
            df = df.hint("rebalance", cluster_by).sortWithinPartitions(cluster_by)
        versions = [int(v[2:]) for v in self._children(name) if v.startswith("v=")]
        target = self.path(name, f"v={max(versions, default=0) + 1:06d}")
        with freeing(df.sparkSession):
            df.write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """Newest version plus all appended batches of a table."""
        versions = self._complete(name, "v=")[-1:]
        folders = versions + self._complete(name, "epoch=")
        if not folders:
            if schema is None:
                raise FileNotFoundError(f"table {name} has no committed data")
            return self.spark.createDataFrame([], schema)
        return self._rows(name, folders, schema)

    def _rows(self, name: str, folders: list[str], schema: T.StructType | None) -> DataFrame:
        """Rows of some folders; batches may lie in buckets, whose number is no column of the table."""
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        if any(f.startswith("v=") for f in folders):
            return reader.parquet(*[self.path(name, f) for f in folders])
        rows = reader.option("basePath", self.path(name)).parquet(*[self.path(name, f) for f in folders])
        return rows.select(*schema.names) if schema is not None else rows.drop("epoch", "_bucket")

    def current(self, name: str) -> str:
        """Folder of the newest committed version, for use as a stream source."""
        return self.path(name, self._complete(name, "v=")[-1])

    def create_if_absent(self, name: str, schema: T.StructType) -> DataFrame:
        if not self.exists(name):
            self.replace(name, self.spark.createDataFrame([], schema))
        return self.read(name, schema)

    # -- appends ---------------------------------------------------------
    def append(self, name: str, df: DataFrame, epoch: int) -> None:
        """Append one batch; writing the same epoch again replaces that batch."""
        with freeing(df.sparkSession):
            df.write.mode("overwrite").parquet(self.path(name, f"epoch={epoch}"))

    def epochs(self, name: str) -> list[int]:
        return sorted(int(e[6:]) for e in self._complete(name, "epoch="))

    def batch_number(self, name: str, query: str, epoch: int) -> int:
        """Number under which a query appends its batch ``epoch`` to a table.

        A query whose checkpoint is new counts on after the batches that other
        queries appended, so it never overwrites one; a batch that it repeats
        keeps its number.
        """
        for child in self._children("_queries", name):
            known, _, base = child.partition("=")
            if known == query:
                return int(base) + epoch
        used = [int(c[6:]) for c in self._children(name) if c.startswith("epoch=")]
        base = max(used, default=-1) + 1 - epoch
        fs, jpath = self._fs(self.path("_queries", name, f"{query}={base}"))
        fs.mkdirs(jpath)
        return base + epoch

    def read_except(self, name: str, epoch: int, schema: T.StructType) -> DataFrame:
        """Table contents without the batch ``epoch``."""
        return self._batches(name, [e for e in self.epochs(name) if e != epoch], schema)

    def read_before(self, name: str, epoch: int, schema: T.StructType) -> DataFrame:
        """Table contents without the batches from ``epoch`` on."""
        return self._batches(name, [e for e in self.epochs(name) if e < epoch], schema)

    def _batches(self, name: str, epochs: list[int], schema: T.StructType) -> DataFrame:
        folders = self._complete(name, "v=")[-1:] + [f"epoch={e}" for e in epochs]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self._rows(name, folders, schema)


def typed_read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read with a declared schema: no inference pass, only declared columns."""
    return spark.read.schema(schema).parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast a query to a declared schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Column defaults on insert: missing columns are added, nulls are filled."""
    filled = {
        name: F.coalesce(F.col(name), value) if name in df.columns else value
        for name, value in defaults.items()
    }
    return df.withColumns(filled)
