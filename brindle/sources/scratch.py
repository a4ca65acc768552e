"""Tables written to the shared folder, to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that cross to Python at once while a scratch table is written: whole texts are in these batches, on both sides.
BATCH_ROWS = 1000
#: Used only where the session names no folder (tests, one machine).
LOCAL_DEFAULT = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one is set only where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_DEFAULT
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/brindle/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows; the session's own setting comes back at the end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    if not 0 < int(own) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, own)


def lean_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on, for a job whose stages hand whole texts to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def stored(df: DataFrame, name: str, codec: str = "zstd", **options: object) -> DataFrame:
    """Write df as Parquet in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", codec)
    for key, value in options.items():
        writer = writer.option(key.replace("__", "."), str(value))
    with small_batches(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_if_small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its rows, counted now, take at most `limit` bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def balanced(df: DataFrame, task_bytes: int = 64 << 20) -> DataFrame:
    """df dealt over all cores, if it is too small to fill them by itself: a small file is one row group, so one task.

    A table of more than `task_bytes` for each core is left as its files lie, and so is a stream.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > cores * task_bytes:
        return df
    return df.repartition(cores)


def release(df: DataFrame) -> None:
    """Delete the scratch tables that df reads, once nothing needs them."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = f"{shared_dir(spark)}/brindle/"
    for folder in {root + f.split("/brindle/", 1)[1].split("/")[0] for f in df.inputFiles() if "/brindle/" in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
