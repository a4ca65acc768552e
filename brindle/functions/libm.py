"""Exponential and logarithm of the C library, and rounding by scaling: the doubles that DuckDB makes, where Spark's own differ in the last bit or at a tie."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.arrow_udf(DoubleType())
def exp(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else math.exp(v) for v in x.to_pylist()], pa.float64())


@F.arrow_udf(DoubleType())
def log(x: pa.Array) -> pa.Array:
    """Of positive numbers."""
    return pa.array([None if v is None else math.log(v) for v in x.to_pylist()], pa.float64())


def scaled_round(x: Column | str, digits: int) -> Column:
    """x * 10^digits as a double, rounded half away from zero, divided again (Spark's round takes the shortest decimal of x instead)."""
    return F.round((F.col(x) if isinstance(x, str) else x) * 10.0**digits, 0) / 10.0**digits
