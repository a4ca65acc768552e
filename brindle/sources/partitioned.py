"""Versioned output: tables partitioned by a column, of which a run replaces only the partitions it writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.sources.scratch import new_path


def write_partitions(df: DataFrame, by: str, path: str | None = None, *, name: str = "partitions") -> str:
    """df as Parquet in one folder for each value of `by`; partitions that df has are replaced, others stay as they are.

    This takes the place of deleting stale files: what a new version recomputes replaces the old rows when its job
    commits, and a failed job replaces nothing.  Rows are gathered by partition first, so a task writes few files; a
    large partition is split by the rows' hash.
    """
    path = path or new_path(df.sparkSession, name)
    df.repartition(F.col(by), F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return path


def read_partition(spark: SparkSession, path: str, schema: StructType | str, by: str, *values: object) -> DataFrame:
    """The rows of some partitions (all, if none is named); files of others are not listed as input."""
    df = spark.read.schema(schema).parquet(path)
    return df.filter(F.col(by).isin(*values)) if values else df
