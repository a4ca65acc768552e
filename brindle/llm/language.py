"""Language identification by error-correcting output codes.

Each language gets a codeword of bits; for each bit a binary classifier over hashed byte n-grams
(A-Z as a-z, 1 to `max_n` bytes) is trained to predict it.  A text's n-grams are averaged, each bit
answers with a signed margin, and loss-weighted decoding takes the codeword with the least weighted
hinge loss, the weights being each bit's accuracy on the fitting sample.  A text whose two nearest
codewords lie close together is flagged as ambiguous; one that is null or has no letter is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.tokens import forget
from brindle.llm.words import blocks

UNDETERMINED = "und"
#: Texts that the model is fitted on at most (one of each language at least); whole texts are read, here and in predictions.
FIT_TEXTS = 2000
#: Buckets of hashed n-grams.
BUCKETS = 1 << 12
#: Bytes of text whose margins are computed at once; one longer text makes a block of its own (memory only).
TEXT_BLOCK = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[0x41:0x5B] += 32


def codewords(n: int) -> np.ndarray:
    """n rows of +-1.  Up to 7 languages: the exhaustive code (all ways to split them in two); beyond: rows of a Hadamard matrix."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = [[1.0] + [1.0 if v >> i & 1 else -1.0 for i in range(n - 1)] for v in range(2 ** (n - 1) - 1)]
        return np.array(bits).T
    size = 1 << max(4, int(np.ceil(np.log2(2 * n))))
    h = np.ones((1, 1))
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[1 : n + 1, 1:]


def ngram_buckets(raw: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that ends at each byte (the first n - 1 of the block are shorter)."""
    low = _LOWER[raw]
    h = low.copy()
    for j in range(1, n):
        h[j:] += low[: len(low) - j] * np.uint32(pow(0x01000193, j, 2**32))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
    return (h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (max_n, BUCKETS, bits)
    bias: np.ndarray
    trust: np.ndarray
    margin: float = 0.05

    def margins(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Signed answers of all bits for each text: the mean over its n-grams, whole text."""
        sizes = np.diff(offs)
        out = np.zeros((len(sizes), self.code.shape[1]))
        if len(raw):
            full = np.flatnonzero(sizes > 0)
            for n in range(1, len(self.weights) + 1):
                each = self.weights[n - 1][ngram_buckets(raw, n)]
                for j in range(1, n):  # n-grams that would reach into the text before
                    at = offs[full] + j - 1
                    each[at[at < offs[full + 1]]] = 0
                out[full] += np.add.reduceat(each, offs[full], axis=0)
        return out / np.maximum(sizes, 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest codeword, score from 0 to 1, ambiguous)."""
        loss = (np.maximum(0, 1 - margins[:, None, :] * self.code[None]) * self.trust).sum(axis=2) / max(self.trust.sum(), 1e-12)
        share = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ranked = np.sort(loss, axis=1)
        close = ranked[:, 1] - ranked[:, 0] < self.margin if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, share[np.arange(len(best)), best], close


def frequencies(text: str, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, share) of the hashed n-grams of a whole text: at most max_n * BUCKETS of them, however long it is."""
    raw = np.frombuffer(text.encode(), np.uint8)
    full = np.zeros(max_n * BUCKETS)
    for lo in range(0, len(raw), 1 << 20):
        part = raw[max(0, lo - max_n + 1) : lo + (1 << 20)]
        for n in range(1, max_n + 1):
            skip = n - 1 if not lo else max_n - 1
            full[(n - 1) * BUCKETS : n * BUCKETS] += np.bincount(ngram_buckets(part, n)[skip:], minlength=BUCKETS)
    at = np.flatnonzero(full)
    return at.astype(np.int32), (full[at] / max(len(raw), 1)).astype(np.float32)


def train(sample: list[tuple[np.ndarray, np.ndarray]], langs: list[str], max_n: int = 3, rounds: int = 200, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """Logistic bits on standardised hashed frequencies, full-batch gradient steps with momentum; no randomness."""
    languages = sorted(set(langs))
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((max_n, BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    x = np.zeros((len(sample), max_n * BUCKETS), np.float32)
    for i, (at, share) in enumerate(sample):
        x[i, at] = share
    y = code[[languages.index(v) for v in langs]]
    squares = np.zeros(x.shape[1], np.float32)
    for row in x:  # not the squares of all at once: the driver holds one such matrix only
        squares += row * row
    scale = np.sqrt(squares / len(x)) + 1e-4
    x /= scale
    x /= np.sqrt(x.shape[1])
    w, bias, push, push_b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1]), 0.0, 0.0
    for _ in range(rounds):
        pull = -y / (1 + np.exp(np.clip(y * (x @ w + bias), -30, 30)))
        push = 0.9 * push - rate * (x.T @ pull.astype(np.float32) / len(sample) * 20 + decay * w)
        push_b = 0.9 * push_b - rate * pull.mean(axis=0)
        w, bias = w + push, bias + push_b
    answers = x @ w + bias
    trust = np.maximum((np.sign(answers) == y).mean(axis=0), 0.5)
    w = (w / scale[:, None] / np.sqrt(x.shape[1])).astype(np.float32)
    return Model(languages, code, w.reshape(max_n, BUCKETS, -1), bias, trust)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_texts: int = FIT_TEXTS, max_n: int = 3) -> Model:
    """Fit on labelled, not held-out documents; the sample is chosen without its texts, then read whole and counted on the executors.

    Every language gets an equal part of `fit_texts`, its documents of least hash, one at least; one that has fewer gives all.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).cast("string").alias("__text"), F.col(lang_col).cast("string").alias("__lang"))
    known = rows.filter(F.col("__lang").isNotNull() & F.col("__text").isNotNull() & ~held_out("__id") & F.col("__id").isNotNull())
    ids = known.select("__id", "__lang", F.pmod(F.xxhash64("__id"), F.lit(1 << 40)).alias("__key"))
    sizes = ids.groupBy("__lang").agg(F.count("*").alias("__n"), F.min("__key").alias("__least")).toArrow()
    if not sizes.num_rows:
        return train([], [])
    each = max(1, fit_texts // sizes.num_rows)
    # The documents below a language's bound are about twice what it needs and 50; its least is always among them.
    bound = F.greatest("__least", (F.lit(float(1 << 40)) * (2 * each + 50) / F.col("__n")).cast("long"))
    bounds = F.broadcast(docs.sparkSession.createDataFrame(sizes).select(F.col("__lang"), bound.alias("__bound")))
    turn = F.row_number().over(Window.partitionBy("__lang").orderBy("__key", "__id"))
    near = ids.join(bounds, "__lang").filter("__key <= __bound").select("__id", "__lang", "__key").distinct()
    chosen = near.withColumn("__turn", turn).filter(F.col("__turn") <= each).select("__id", "__lang", "__turn")
    drawn = known.join(F.broadcast(chosen), ["__id", "__lang"]).groupBy("__id", "__lang").agg(F.min("__text").alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [frequencies(t, max_n) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32()))], names=["lang", "key", "at", "share"])

    counted = drawn.select("__lang", "__text", F.xxhash64("__text")).mapInArrow(count, "lang string, key long, at array<int>, share array<float>")
    sample = counted.orderBy("key", "lang").toArrow()
    model = train(_views(sample), sample.column("lang").to_pylist(), max_n)
    del sample
    forget()  # the driver goes on with other stages
    return model


def _views(sample: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(at, share) of each row as slices of the table's own memory."""
    at, share = (sample.column(c).combine_chunks() for c in ("at", "share"))
    places, shares = (x.values.to_numpy() for x in (at, share))
    return [(places[a:b], shares[c:d]) for a, b, c, d in zip(at.offsets[:-1].to_pylist(), at.offsets[1:].to_pylist(), share.offsets[:-1].to_pylist(), share.offsets[1:].to_pylist())]


def held_out(id_string: str):
    """crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_string).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row, from the whole text.

    Null texts and texts without a letter are `und` with score 0 and not ambiguous; so is everything if
    no language was learned.  Rows with equal doc_id each get a row; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return label(rows, model, text_col=text_col, names=("lang_pred", "score", "ambiguous")).drop(text_col)


def label(docs: DataFrame, model: Model, *, text_col: str = "text", names: tuple[str, str, str] = ("__lang_pred", "__score", "__ambiguous")) -> DataFrame:
    """All rows and columns of docs and three more: the language, its score and whether it is ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = shared.value
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            for lo, hi, raw, offs in blocks(texts, TEXT_BLOCK):
                letters = np.array([t is not None and _LETTER.search(t) is not None for t in texts[lo:hi].to_pylist()], bool) & bool(m.languages)
                if m.languages:
                    best, score, close = m.decode(m.margins(raw, offs))
                else:
                    best, score, close = np.zeros(hi - lo, int), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                found = [m.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist())]
                new = [pa.array(found, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(close & letters)]
                yield pa.record_batch([*batch.slice(lo, hi - lo).columns, *new], names=[*batch.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(answer, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))]))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: held_out, lang_pred, score and ambiguous of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")
