"""Tables that jobs write on the way, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of its own only where none is set and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="souk-")
        spark.sparkContext.setCheckpointDir(folder)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once: later uses read them and nothing before runs again.

    The driver then collects its garbage: Spark deletes the shuffle files of what is written, which
    would else stay on disk until the driver happens to do so.
    """
    spark = df.sparkSession
    shared(spark)
    out = df.checkpoint()
    del df  # else its plan holds on to the shuffle files
    for _ in range(2):  # the first frees what the second can find
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """As stored(), as a Parquet table: its size is known afresh.

    A checkpoint keeps the size that was estimated for its plan, which loops of joins multiply
    until the optimizer spends its time on the numbers.
    """
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
