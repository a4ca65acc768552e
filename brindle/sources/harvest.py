"""Budgeted harvest from several sources in order.

Sources are opened one after another, none after the budget is spent; one that cannot be opened, or has no training
split, is skipped.  Of a source only as much text is read as the budget may need: the order columns alone are numbered
(a narrow table), and slices of the order are read and summed, each twice as long as the one before, until the budget
is reached; inside the last slice the cut is found by sums of partitions.  A source that fails midway keeps the slices
before the failure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import approx_tokens
from brindle.operators.corpus import longest_string, training_splits
from brindle.operators.order import numbered, running
from brindle.sources.scratch import release, stored


@dataclass(frozen=True)
class Source:
    """open gives a table or splits by name; order: columns that order the rows (empty: files and their rows); text: the text of a row, null for none."""

    name: str
    open: Callable[[], DataFrame | dict[str, DataFrame]]
    order: tuple[str, ...] = ()
    text: Callable[[DataFrame], Column] = longest_string


@dataclass
class Taken:
    """What became of a source: status is taken, skipped, empty, stopped (failed midway) or unopened; rows_read counts rows whose text was read."""

    source: str
    status: str
    tokens: int = 0
    rows_read: int = 0
    reason: str = ""
    parts: list[DataFrame] = field(default_factory=list, repr=False)


def at_most(order: list[str], key: tuple, df: DataFrame) -> Column:
    """Whether a row stands at the key or before it; the condition on the first column reaches the scan."""
    kinds = dict(df.dtypes)
    values = [F.lit(v).cast(kinds[c]) for c, v in zip(order, key)]
    first = F.col(order[0]).isNull() | (F.col(order[0]) <= values[0]) if key[0] is not None else F.col(order[0]).isNull()
    return first & (F.struct(*order) <= F.struct(*[v.alias(c) for c, v in zip(order, values)]))


def _slice(rows: DataFrame, order: list[str], low: tuple | None, high: tuple) -> DataFrame:
    out = rows.filter(at_most(order, high, rows))
    return out if low is None else out.filter(F.struct(*order) > F.struct(*[F.lit(v).cast(dict(rows.dtypes)[c]).alias(c) for c, v in zip(order, low)]))


def take_until(df: DataFrame, order: list[str], text: Column, left: int | None, *, max_chars: int, least_tokens: int, log: Taken) -> DataFrame | None:
    """The first rows of df in order whose tokens, before each, are below `left`: order columns, text, tokens; null texts are passed over."""
    cut = F.substring(text, 1, max_chars)
    texts = lambda part: part.select(*order, cut.alias("text")).filter("text IS NOT NULL AND text != ''").withColumn("tokens", approx_tokens("text"))
    if left is None:
        rows = texts(df)
        log.status, log.tokens = "taken", rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        return rows
    places = stored(numbered(df.select(*order), [F.col(c) for c in order]), "harvest-places")
    n, at, size, low, kept = places.count(), 0, left // least_tokens + 1, None, None
    key_at = lambda pos: tuple(places.filter(F.col("pos") == pos).select(*order).first())
    while at < n:
        end = min(n, at + size)
        high = key_at(end - 1)
        part = texts(_slice(df, order, low, high))  # the place first: texts outside the slice are not looked at
        try:
            total = part.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
            log.rows_read += end - at
            if log.tokens + total >= left:
                inside = running(part.select(*order, "tokens"), [F.col(c) for c in order], {"before": F.col("tokens")}).filter(F.col("before") < left - log.tokens)
                last = inside.agg(F.max(F.struct(*order)).alias("k"), F.sum("tokens").alias("t")).first()
                kept, log.tokens, log.status = tuple(last["k"]), log.tokens + last["t"], "taken"
                break
        except Exception as e:  # noqa: BLE001  any reader may fail in its own way
            log.status, log.reason = "stopped", (str(e).splitlines() or [type(e).__name__])[0]
            break
        log.tokens += total
        kept, low, at, size, log.status = high, high, end, 2 * size, "taken"
    release(places)
    if kept is None:
        log.status = "empty" if not n else log.status
        return None
    return texts(df.filter(at_most(order, kept, df)))


def harvest_sources(spark: SparkSession, sources: list[Source], *, token_budget: int | None, max_chars: int = 6000, least_tokens: int = 20) -> tuple[DataFrame, list[Taken]]:
    """(src_ord, source, id, text, tokens; what became of each source): rows in order until the budget is spent, the last may overshoot.

    id: the last order column as a string.  The budget is looked at before each row; None takes all.  least_tokens is a
    guess at the tokens of a row (texts of 80 characters have 20): it sets the first slice, never the result.
    """
    log, out, used = [], [], 0
    for i, source in enumerate(sources):
        log.append(Taken(source.name, "unopened"))
        if token_budget is not None and used >= token_budget:
            continue
        try:
            found = source.open()
            splits = [found] if isinstance(found, DataFrame) else [found[s] for s in training_splits(list(found))]
        except Exception as e:  # noqa: BLE001
            log[-1].status, log[-1].reason = "skipped", (str(e).splitlines() or [type(e).__name__])[0]
            continue
        log[-1].status = "empty" if splits else "skipped"
        for split in splits:
            if token_budget is not None and used >= token_budget:
                break
            order = list(source.order)
            if not order:
                split = split.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
                order = ["__file", "__row"]
            part = Taken(source.name, log[-1].status)
            try:
                rows = take_until(split, order, source.text(split), None if token_budget is None else token_budget - used, max_chars=max_chars, least_tokens=least_tokens, log=part)
            except Exception as e:  # noqa: BLE001
                log[-1].status, log[-1].reason = "skipped", (str(e).splitlines() or [type(e).__name__])[0]
                break
            used += part.tokens
            log[-1].tokens += part.tokens
            log[-1].rows_read += part.rows_read
            log[-1].status, log[-1].reason = part.status, part.reason
            if rows is not None:
                out.append(rows.select(F.lit(i).alias("src_ord"), F.lit(source.name).alias("source"), F.col(order[-1]).cast("string").alias("id"), "text", "tokens"))
            if part.status == "stopped":
                break
    empty = spark.createDataFrame([], "src_ord int, source string, id string, text string, tokens long")
    return reduce(DataFrame.unionByName, out) if out else empty, log
