"""Global order without a single task: range partitions, a small table of their sums, and windows inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.keyed import md5_32
from brindle.sources.scratch import stored


def running(df: DataFrame, order: list[Column], values: dict[str, Column], partitions: int | None = None, name: str = "ranged") -> DataFrame:
    """df with, for each value, the sum over all earlier rows in the global order.

    The rows are range-partitioned once and stored; only one row for each partition is summed in one task.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.withColumns({f"__v_{k}": v for k, v in values.items()}).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), name)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__part").agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in values])
    bases = sums.select("__part", *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in values])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(bases), "__part")  # one row for each partition
    return out.withColumns({k: F.col(f"__b_{k}") + F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) for k in values}).select(*df.columns, *values)


def numbered(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """df with its 0-based place in the global order."""
    return running(df, order, {name: F.lit(1).cast("long")})


def shuffled(seed: int, *key: str) -> list[Column]:
    """An order that depends on the seed and the key alone."""
    return [md5_32(F.lit(seed), *key), *map(F.col, key)]


def take_first(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)
