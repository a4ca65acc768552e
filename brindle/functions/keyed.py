"""Keyed randomness: the same row draws the same number whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_32(*parts: Column | str) -> Column:
    """The first 32 bits of the MD5 of the parts' strings joined by '|'."""
    joined = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def uniform(seed: int, *key: Column | str) -> Column:
    """A number in (0, 1)."""
    return (md5_32(F.lit(seed), *key) + 0.5) / F.lit(2.0**32)


def gumbel(seed: int, *key: Column | str) -> Column:
    return -F.log(-F.log(uniform(seed, *key)))
