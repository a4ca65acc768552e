"""Corpus operators: harvest, gates, splits, resampling, curriculum, replay."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import libm
from brindle.functions.keyed import gumbel, md5_32
from brindle.functions.text import approx_tokens, clean_text, word_count
from brindle.operators.order import numbered, running, shuffled, take_first
from brindle.sources.scratch import balanced, shared_if_small, stored


def harvest(docs: DataFrame, order: list[Column], *, token_budget: int | None, max_chars: int = 6000, text_col: str = "text") -> DataFrame:
    """Rows in order while the tokens before them are below the budget (the last may overshoot); text is cut to max_chars; adds tokens.

    Only the order's columns and the token counts are ordered; the texts are read again up to the last row that fits, by
    a condition on the order.  Where rows that agree in the order stand on both sides of the budget, whole rows are
    ordered instead.
    """
    rows = docs.filter(F.col(text_col).isNotNull()).withColumn(text_col, F.substring(text_col, 1, max_chars)).withColumn("tokens", approx_tokens(text_col))
    if token_budget is None:
        return rows
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    narrow = rows.select(key.alias("__key"), "tokens")
    placed = running(narrow, [F.col("__key")], {"__before": F.col("tokens")}, name="harvest-tokens")
    fits = F.col("__before") < token_budget
    cut = placed.filter(fits).agg(F.max("__key").alias("k"))
    ends = placed.join(F.broadcast(cut), F.col("__key") == F.col("k")).agg(F.bool_and(fits).alias("whole"), F.first("k").alias("k")).first()  # one row
    if ends["k"] is None:
        return rows.limit(0)
    if not ends["whole"]:
        return running(rows, order, {"__before": F.col("tokens")}).filter(F.col("__before") < token_budget).drop("__before")
    kinds = narrow.schema["__key"].dataType.fields
    last = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(ends["k"], kinds)])
    return rows.filter(key <= last)


def training_splits(splits: list[str]) -> list[str]:
    """The splits that count as training: train/training if any is so named, else those without test, valid, dev or eval in their name."""
    named = [s for s in splits if s.lower() in ("train", "training")]
    return named or [s for s in splits if not re.search("test|valid|dev|eval", s, re.IGNORECASE)]


def longest_string(df: DataFrame, min_chars: int = 80, skip: tuple[str, ...] = ()) -> Column:
    """The longest string column with more than min_chars (first of equals), else the first list of strings joined, else null."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType) and f.name not in skip]
    out = F.lit(None).cast("string")
    for c in reversed(lists):
        joined = F.array_join(c, " ")
        out = F.when(F.length(joined) > min_chars, joined).otherwise(out)
    if strings:
        ranked = F.array(*[F.struct(F.coalesce(F.length(c), F.lit(0)).alias("n"), F.lit(-i).alias("first"), F.col(c).alias("s")) for i, c in enumerate(strings)])
        best = F.array_max(ranked)
        out = F.when(best["n"] > min_chars, best["s"]).otherwise(out)
    return out


def plain_texts(df: DataFrame, text_col: str = "text", min_chars: int = 80) -> DataFrame:
    return df.filter(F.length(text_col) > min_chars)


def length_gate(df: DataFrame, tokens: Column, low: int = 24, high: int = 2048) -> DataFrame:
    """Rows whose token count lies in [low, high]."""
    return df.filter(tokens.between(low, high))


def clean_and_gate(df: DataFrame, *, low: int = 24, high: int = 2048, text_col: str = "text") -> DataFrame:
    """Cleaned, non-empty texts within the gate, counted in white-space tokens."""
    rows = balanced(df).withColumn(text_col, clean_text(text_col)).filter(F.col(text_col) != "")
    return length_gate(rows.withColumn("words", word_count(text_col)), F.col("words"), low, high)


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """ord, stage, docs, removed (may be negative) of stages of a pipeline."""
    counts = None
    for i, (name, df) in enumerate(stages):
        row = df.agg(F.count("*").alias("docs")).select(F.lit(i).alias("ord"), F.lit(name).alias("stage"), "docs")
        counts = row if counts is None else counts.unionByName(row)
    return counts.withColumn("removed", F.coalesce(F.lag("docs").over(Window.orderBy("ord")) - F.col("docs"), F.lit(0)))  # as many rows as stages


#: Bytes of a vocabulary that goes to all tasks, and of one of its words.
VOCABULARY_BYTES, _WORD_BYTES = 32 << 20, 48


def unigram_perplexity(docs: DataFrame, corpus: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", cap: float = 20.0) -> DataFrame:
    """id, ppl: exp of the mean negative log-likelihood under the add-one unigrams of the corpus (docs themselves, if none is given), at most exp(cap).

    Words are counted once and stored.  The most frequent words that VOCABULARY_BYTES hold go to all tasks, and a
    document's words are added where they lie, in their order, so equal texts have equal values.  A word of docs that
    the counts from 2 on do not have occurs once; only if repeated words are left over are rarer words shuffled.
    """
    split = lambda df, *own: df.select(*own, F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+")).alias("w")).filter("w != ''")
    own = balanced(docs.select(id_col, text_col))
    counts = stored(split(own if corpus is None else balanced(corpus.select(text_col))).groupBy("w").agg(F.count("*").alias("c")), "word-counts")
    floors = [1 << i for i in range(1, 41)]
    sizes = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), *[F.count_if(F.col("c") >= f).alias(f"from_{f}") for f in floors]).first()  # one row
    total = float(max(1, sizes["n"] + sizes["v"]))
    floor = next((f for f in floors if sizes[f"from_{f}"] * _WORD_BYTES <= VOCABULARY_BYTES), floors[-1])
    valued = counts.select("w", "c", (-libm.log((F.col("c") + 1.0) / total)).alias("nll"))
    once = F.lit(-math.log(2.0 / total))
    found = split(own, id_col).join(F.broadcast(valued.filter(F.col("c") >= floor).select("w", "nll")), "w", "left")  # of a counted size
    sums = lambda df, nll: df.groupBy(id_col).agg(F.sum(nll).alias("s"), F.count("*").alias("k"))
    if corpus is None and floor == 2:
        per_doc = sums(found, F.coalesce("nll", once))
    else:
        rare = found.filter("nll IS NULL").select(id_col, "w")
        if corpus is None:
            rare = rare.join(valued.filter((F.col("c") > 1) & (F.col("c") < floor)), "w", "left")
        else:  # what the corpus lacks has no value
            rare = rare.join(valued.filter(F.col("c") < floor), "w")
        both = sums(found.filter("nll IS NOT NULL"), F.col("nll")).unionByName(sums(rare, F.coalesce("nll", once)))
        per_doc = both.groupBy(id_col).agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    scored = docs.select(id_col).join(per_doc, id_col, "left")
    return scored.select(id_col, libm.exp(F.least(F.lit(cap), F.coalesce("s", F.lit(0.0)) / F.greatest(F.lit(1), F.coalesce("k", F.lit(0))))).alias("ppl"))


def perplexity_filter(scored: DataFrame, low: float = 3.0, high: float = 200.0) -> DataFrame:
    return scored.filter(F.col("ppl").between(low, high))


def score_sample_impute(docs: DataFrame, score: Callable[[DataFrame], DataFrame], cap: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Only a seeded sample of `cap` documents is scored, by score(documents) -> (id, ppl); the others get the median of the sample."""
    chosen = shared_if_small(stored(take_first(docs.select(id_col), shuffled(seed, id_col), cap), "sample-ids"), 24)
    sample = stored(score(docs.join(chosen, id_col, "left_semi")), "sample-scores")
    median = sample.agg(F.percentile("ppl", F.lit(0.5)).alias("__median"))
    return docs.select(id_col).join(sample, id_col, "left").join(F.broadcast(median)).select(id_col, F.coalesce("ppl", "__median").alias("ppl"))  # one row


#: Words and word pairs whose feature a worker remembers (speed only).
_KNOWN_GRAMS = 400_000


class _Features(dict):
    """The feature of a word or word pair, hashed at its first use."""

    def __init__(self, features: int) -> None:
        self.features = features

    def __missing__(self, gram: str) -> int:
        import hashlib

        f = self[gram] = int.from_bytes(hashlib.md5(gram.encode()).digest()[:4], "big") % self.features
        return f


def hashed_ngrams(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", features: int = 1 << 18) -> DataFrame:
    """id, f: the features of all hashed word unigrams and bigrams of a text (words of two letters or more, lower case), as often as they occur, in Arrow batches."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa
    import regex

    kind = dict(docs.dtypes)[id_col]
    word = regex.compile(r"[\p{L}\p{N}_]{2,}")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features(features)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found, ends = [], [0]
                for text in part.column(1).to_pylist():
                    w = word.findall(text or "")
                    found += map(known.__getitem__, w)
                    found += map(known.__getitem__, map(" ".join, zip(w, w[1:])))
                    ends.append(len(found))
                    if len(known) > _KNOWN_GRAMS:
                        known.clear()
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(found, np.int32)))], names=[id_col, "f"])

    return balanced(docs.select(id_col, F.col(text_col).cast("string").alias(text_col))).select(id_col, F.lower(text_col)).mapInArrow(hashed, f"`{id_col}` {kind}, f array<int>")


def feature_counts(grams: DataFrame, features: int, name: str) -> DataFrame:
    """feature, `name`: how often each feature occurs in the lists f; a task gives at most `features` rows."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(features, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=features)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["feature", "c"])

    return grams.select("f").mapInArrow(count, "feature long, c long").groupBy("feature").agg(F.sum("c").alias(name))


def dsir_weights(raw: DataFrame, target: DataFrame, *, id_col: str = "doc_id", target_id: str = "item_id", features: int = 1 << 18) -> DataFrame:
    """id, weight: mean log ratio of the smoothed target and raw feature probabilities over a document's n-grams.

    Texts are read once: their features are stored, one list for each document.  The ratios are one number for each
    feature, at most `features`, and go to all tasks, where a document's are added in place.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    mine = stored(hashed_ngrams(raw, id_col=id_col, features=features), "ngram-features")
    theirs = feature_counts(hashed_ngrams(target, id_col=target_id, features=features), features, "t")
    both = feature_counts(mine, features, "r").join(theirs, "feature", "full").fillna(0, ["r", "t"]).toArrow()  # at most `features` rows
    r, t = np.zeros(features), np.zeros(features)
    at = both.column("feature").to_numpy()
    r[at], t[at] = both.column("r").to_numpy(), both.column("t").to_numpy()
    ratios = raw.sparkSession.sparkContext.broadcast(np.log((t + 1.0) / (t.sum() + features)) - np.log((r + 1.0) / (r.sum() + features)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = ratios.value[lists.flatten().to_numpy()]
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            sums = [float(values[a:b].sum()) for a, b in zip(ends, ends[1:])]
            yield pa.record_batch([batch.column(0), pa.array(sums, pa.float64()), pa.array(np.diff(ends))], names=[id_col, "s", "k"])

    scored = mine.mapInArrow(score, f"`{id_col}` {dict(raw.dtypes)[id_col]}, s double, k long").groupBy(id_col).agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    out = raw.select(id_col).join(scored, id_col, "left").select(id_col, (F.coalesce("s", F.lit(0.0)) / F.greatest(F.coalesce("k", F.lit(0)), F.lit(1))).alias("weight"))
    return stored(out, "dsir-weights")


def dsir_resample(weights: DataFrame, *, keep_frac: float = 0.7, keep_n: int | None = None, seed: int = 42, id_col: str = "doc_id", temperature: float = 1.0) -> DataFrame:
    """The n best of weight + Gumbel noise, best first, with key and place."""
    total = weights.count()
    n = keep_n if keep_n is not None else min(max(int(round(total * keep_frac)), 1), total)
    keyed = weights.withColumn("key", F.col("weight") + temperature * gumbel(seed, id_col))
    return numbered(keyed, [F.desc("key"), F.col(id_col)]).filter(F.col("pos") < n)


def curriculum(scored: DataFrame, *, scheme: str = "bucketed", buckets: int = 5, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Rows with bucket and pos: ascending perplexity, or equal buckets of it each in its own shuffled order."""
    if scheme not in ("ascending", "bucketed"):
        raise ValueError("scheme: ascending or bucketed")
    ranked = numbered(scored, [F.col("ppl"), F.col(id_col)], "rank")
    if scheme == "ascending":
        return ranked.withColumn("bucket", F.lit(0)).withColumnRenamed("rank", "pos")
    n = scored.count()
    small, extra = n // buckets, n % buckets  # the first `extra` buckets hold one more
    r = F.col("rank")
    bucket = F.when(r < extra * (small + 1), F.floor(r / (small + 1))).otherwise(extra + F.floor((r - extra * (small + 1)) / max(small, 1)))
    return numbered(ranked.withColumn("bucket", bucket.cast("int")), [F.col("bucket"), *shuffled(seed, id_col)]).drop("rank")


def interleave_replay(domain: DataFrame, replay: DataFrame, *, ratio: float = 0.25, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Domain rows in order of `pos` with a share of replay rows spread among them: kind, pos and the common columns."""
    n = domain.count()
    pool = replay.count()
    want = int(round(n * ratio / max(1e-9, 1 - ratio)))
    count = 0 if pool == 0 or ratio <= 0 else min(want, pool)
    every = max(1, n // count) if count else 1
    own = domain.withColumn("kind", F.lit("domain")).withColumn("pos", F.col("pos") + F.least(F.lit(count), F.floor(F.col("pos") / every)))
    if not count:
        return own
    j = F.col("pos")
    extra = numbered(replay, shuffled(seed, id_col)).filter(j < count)
    extra = extra.withColumn("kind", F.lit("replay")).withColumn("pos", F.when((j + 1) * every <= n, (j + 1) * every + j).otherwise(n + j))
    return own.unionByName(extra.select(own.columns))


def validation_split(ordered: DataFrame, *, share: float = 0.02, least: int = 200, tail: bool = True) -> DataFrame:
    """Adds split: the tail (or head) max(least, share) rows are val; never the whole corpus."""
    n = ordered.count()
    k = min(max(least, int(n * share)), n // 2)
    val = F.col("pos") >= n - k if tail else F.col("pos") < k
    return ordered.withColumn("split", F.when(val, "val").otherwise("train"))


def carve(df: DataFrame, seed: int, test_share: int = 20, val_share: int = 10, least: int = 50, *, id_col: str = "doc_id") -> DataFrame:
    """Adds split by a seeded shuffle: max(least, n // test_share) test rows, then max(least, n // val_share) val rows, the rest train."""
    n = df.count()
    t, v = max(least, n // test_share), max(least, n // val_share)
    rows = numbered(df, shuffled(seed, id_col))
    return rows.withColumn("split", F.when(F.col("pos") < t, "test").when(F.col("pos") < t + v, "val").otherwise("train")).drop("pos")


def carve_holdout(df: DataFrame, seed: int, share: int = 10, least: int = 50, *, id_col: str = "doc_id") -> DataFrame:
    """Adds split to rows that have a training split only: max(least, n // share) test rows of a seeded shuffle, the rest train."""
    k = max(least, df.count() // share)
    return numbered(df, shuffled(seed, id_col)).withColumn("split", F.when(F.col("pos") < k, "test").otherwise("train")).drop("pos")


def exemplar_pool(df: DataFrame, size: int = 200, seed: int = 42, *, id_col: str = "doc_id", by: str | None = None) -> DataFrame:
    """Adds pool: true for `size` rows drawn (of each group, if asked for)."""
    draw = shuffled(seed, id_col)
    if by is None:
        return numbered(df, draw, "__p").withColumn("pool", F.col("__p") < size).drop("__p")
    return df.withColumn("pool", F.row_number().over(Window.partitionBy(by).orderBy(*draw)) <= size)


def demos_stratified(pool: DataFrame, k: int, key: str, seed: int = 42, *, id_col: str = "doc_id") -> DataFrame:
    """k rows drawn in turn from the groups of `key` (null: _unknown), with their place."""
    rows = pool.withColumn("__g", F.coalesce(F.col(key).cast("string"), F.lit("_unknown")))
    turn = F.row_number().over(Window.partitionBy("__g").orderBy(*shuffled(seed, id_col)))
    order = [F.col("__turn"), md5_32(F.lit(seed), F.col("__g")), F.col("__g")]
    few = rows.withColumn("__turn", turn).filter(F.col("__turn") <= k).orderBy(*order).limit(k)
    return few.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("__turn", "__g")


def training_steps(rows: Column | int, batch: int, accumulate: int, epochs: int) -> Column:
    n = F.lit(rows) if isinstance(rows, int) else rows
    return F.ceil(n / (batch * accumulate)) * epochs


def step_intervals(steps: Column, *, warmup: float = 0.05, save: float = 0.25) -> Column:
    """struct(warmup_steps, save_steps): shares of the steps, whole and at least 1."""
    part = lambda share: F.greatest(F.lit(1), F.floor(steps * share)).cast("long")
    return F.struct(part(warmup).alias("warmup_steps"), part(save).alias("save_steps"))
