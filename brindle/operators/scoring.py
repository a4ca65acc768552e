"""Perplexity by any scorer: truncation, batches of like length, and an interpolated bigram model as a first scorer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.scratch import balanced, small_batches


class Model(Protocol):
    """What a scorer loads once in a Python worker."""

    def tokens(self, text: str) -> list[int]: ...

    def mean_nll(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each row of a padded batch (rows x longest), the mean negative log-likelihood of its tokens from the second on; 0 for fewer than two."""
        ...


class Scorer(Protocol):
    """A small picklable recipe; load() runs on the executors and may read a shared file or a broadcast table."""

    def load(self) -> Model: ...


def perplexities(docs: DataFrame, scorer: Scorer, *, max_len: int = 512, batch_size: int = 8, cap: float = 20.0, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ppl: exp of the mean negative log-likelihood under the scorer, at most exp(cap).

    Texts are cut to max_len tokens.  Within an Arrow batch they are scored in order of length, batch_size at a time, so
    padding is small and a batch's size is bounded; rows keep their ids.  A null text is empty; a text of fewer than two
    tokens has perplexity 1.
    """
    kind = dict(docs.dtypes)[id_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = scorer.load() if model is None else model
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [model.tokens(t or "")[:max_len] for t in part.column(1).to_pylist()]
                lengths = np.array([len(r) for r in rows], np.int64)
                nll = np.zeros(len(rows))
                order = np.argsort(lengths, kind="stable")
                for lo in range(0, len(order), batch_size):
                    of = order[lo : lo + batch_size]
                    width = int(lengths[of].max())
                    if width < 2:
                        continue
                    ids = np.full((len(of), width), pad, np.int64)
                    for i, r in enumerate(of.tolist()):
                        ids[i, : lengths[r]] = rows[r]
                    nll[of] = model.mean_nll(ids, lengths[of])
                yield pa.record_batch([part.column(0), pa.array(np.exp(np.minimum(nll, cap)))], names=[id_col, "ppl"])

    return balanced(docs.select(id_col, F.col(text_col).cast("string").alias(text_col))).mapInArrow(score, f"`{id_col}` {kind}, ppl double")


_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
#: Words whose id a worker remembers (speed only).
_KNOWN = 400_000


def word_ids(text: str, known: dict[str, int]) -> list[int]:
    """32-bit ids of the lower-cased white-space words."""
    out = []
    for w in _SPACE.split(text.lower()):
        if w:
            if (i := known.get(w)) is None:
                i = known[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big")
            out.append(i)
    if len(known) > _KNOWN:
        known.clear()
    return out


def pair_features(first: np.ndarray, second: np.ndarray, features: int) -> np.ndarray:
    return (first * 1_000_003 + second) % features


class Bigram:
    """p(w | v) = weight * c(v w) / c(v) + (1 - weight) * (c(w) + 1) / (n + features), of counts in hashed features."""

    def __init__(self, unigrams: np.ndarray, bigrams: np.ndarray, weight: float) -> None:
        self.unigrams, self.bigrams, self.weight, self.known = unigrams, bigrams, weight, {}
        self.total = float(unigrams.sum())

    def tokens(self, text: str) -> list[int]:
        return word_ids(text, self.known)

    def mean_nll(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        size = len(self.unigrams)
        v, w = ids[:, :-1], ids[:, 1:]
        own = self.bigrams[pair_features(v, w, size)] / np.maximum(self.unigrams[v % size], 1)
        p = self.weight * own + (1 - self.weight) * (self.unigrams[w % size] + 1.0) / (self.total + size)
        live = np.arange(1, ids.shape[1])[None] < lengths[:, None]
        return (-np.log(p) * live).sum(axis=1) / np.maximum(lengths - 1, 1)


class BigramScorer:
    """A Bigram model in a broadcast: two arrays of `features` counts, whatever the corpus."""

    def __init__(self, shared: Any, weight: float) -> None:
        self.shared, self.weight = shared, weight

    def load(self) -> Bigram:
        return Bigram(*self.shared.value, self.weight)


def fit_bigrams(corpus: DataFrame, *, features: int = 1 << 18, weight: float = 0.7, text_col: str = "text") -> BigramScorer:
    """Counts of all the corpus's words and pairs, summed on the executors; at most 2 * features rows reach the driver."""
    spark: SparkSession = corpus.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                one, two = [], []
                for text in batch.column(0).slice(at, 256).to_pylist():
                    ids = np.array(word_ids(text or "", known), np.int64)
                    one.append(ids % features)
                    two.append(pair_features(ids[:-1], ids[1:], features))
                for kind, found in ((1, one), (2, two)):
                    f, c = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(f), kind, np.int32)), pa.array(f), pa.array(c.astype(np.int64))], names=["kind", "feature", "c"])

    counts = balanced(corpus.select(F.col(text_col).cast("string"))).mapInArrow(count, "kind int, feature long, c long").groupBy("kind", "feature").agg(F.sum("c").alias("c"))
    with small_batches(spark):  # else a worker holds 10,000 whole texts at once
        counts = counts.toArrow()
    kind, feature, c = (counts.column(x).to_numpy() for x in ("kind", "feature", "c"))
    tables = []
    for k in (1, 2):
        table = np.zeros(features)
        table[feature[kind == k]] = c[kind == k]
        tables.append(table)
    return BigramScorer(spark.sparkContext.broadcast(tuple(tables)), weight)
