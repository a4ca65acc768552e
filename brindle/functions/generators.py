"""Row-making converters: a plain generator as a table function for SQL and DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_function(make: Callable[..., Iterator[tuple]], schema: str) -> Any:
    """A Python table function whose rows are what make(*arguments) yields; null arguments arrive as None."""

    class Rows:
        def eval(self, *arguments):  # noqa: ANN002, ANN202
            yield from make(*arguments)

    return F.udtf(Rows, returnType=schema)


def register(spark: SparkSession, name: str, make: Callable[..., Iterator[tuple]], schema: str) -> None:
    """Makes the converter known to SQL: SELECT ... FROM t, LATERAL name(t.a, t.b)."""
    spark.udtf.register(name, table_function(make, schema))


def generated(df: DataFrame, name: str, *arguments: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows that a registered converter makes of each row of df, beside the columns to keep."""
    spark = df.sparkSession
    called = ", ".join(f"t.`{a}`" for a in arguments)
    own = "".join(f"t.`{c}`, " for c in keep)
    return spark.sql(f"SELECT {own}g.* FROM {{rows}} t, LATERAL {name}({called}) g", rows=df)


def bio_spans(tokens: list[str] | None, tags: list[str] | None) -> Iterator[tuple[str, int, int, str, int, str]]:
    """kind, first, last, answer, start, context of the entities of BIO tags: the row-at-a-time form of qa.entity_spans, as an example of a converter."""
    if tokens is None or tags is None or len(tokens) != len(tags):
        return
    context = " ".join(tokens)
    for first, tag in enumerate(tags):
        if tag is not None and tag.startswith("B-"):
            last = first
            while last + 1 < len(tags) and (tags[last + 1] or "").startswith("I-" + tag[2:]):
                last += 1
            yield tag[2:], first, last, " ".join(tokens[first : last + 1]), sum(len(t) + 1 for t in tokens[:first]), context


BIO_SCHEMA = "kind string, first int, last int, answer string, start int, context string"
