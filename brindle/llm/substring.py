"""Substring deduplication by hashing units of text.

Units of a document, over its normalised words (white space apart, A-Z as a-z):
- the whole text;
- each line of at least `min_line` words;
- each paragraph (between blank lines) of at least `min_line` words that has a shorter line and is not the
  whole text (other repeated paragraphs go with their lines or with the text);
- passages that do not fill lines: the `run`-word runs that winnowing picks (the least digest of
  each `run` + 1 neighbouring runs), so that any passage of 2 * run words that two documents share
  has a run that both pick, wherever it stands in its line.
Digests are grouped globally and the occurrence of the lowest rank (doc_id, digest of the text,
place) stays; the words of all others go.  An occurrence that overlaps the kept one stays.

The picked runs alone leave holes and ends of a passage.  With `whole_passages` they are anchors only:
the texts are read again, and around each pick whose digest repeats, `run` words to both sides, all
runs are units.  Picks inside a shared passage of 2 * run words or more are the same in both texts, at
most run + 1 apart and at most `run` from its ends, so all its runs are units in both, and it goes whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.tokens import forget
from brindle.llm.words import NONSPACE, blocks, runs, spans, stretches, utf8, word_digests
from brindle.sources.scratch import shared_if_small, stored

UNIT_SCHEMA = "h long, doc_id long, tk long, at int, n int"
#: Bits for each repeated digest in the filter of the second reading, and its most bits.  Both bear on speed only: the digests it lets through are counted.
FILTER_BITS, FILTER_MOST = 16, 1 << 29
_PROBES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def filter_places(h: np.ndarray, bits: int) -> np.ndarray:
    """The places of each digest in a filter of `bits` bits (a power of two), one column for each probe."""
    return (h[:, None] * _PROBES) >> np.uint64(65 - bits.bit_length())


def passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether all places of each digest are set: true for every digest that the filter was made of."""
    out = np.empty(len(h), bool)
    for lo in range(0, len(h), 1 << 15):
        at = filter_places(h[lo : lo + (1 << 15)], 64 * len(words))
        out[lo : lo + (1 << 15)] = ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)
    return out


def digest_filter(digests: DataFrame) -> np.ndarray:
    """A Bloom filter of digests(h), made on the executors: at most FILTER_MOST / 64 rows reach the driver."""
    bits = 1 << min(FILTER_MOST.bit_length() - 1, max(10, (FILTER_BITS * digests.count()).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(filter_places(np.asarray(batch.column(0), np.int64).view(np.uint64), bits))
            w, first = np.unique((at >> np.uint64(6)).astype(np.int32), return_index=True)
            if len(w):
                yield pa.record_batch([pa.array(w), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first).view(np.int64))], names=["w", "bits"])

    got = digests.select("h").mapInArrow(place, "w int, bits long").groupBy("w").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return words.view(np.uint64)


def winnow(digests: np.ndarray, width: int) -> np.ndarray:
    """Places of the least (first of equals) in each `width` neighbours; fewer than `width`: the least of all."""
    if not len(digests):
        return np.zeros(0, np.int64)
    if len(digests) <= width:
        return np.array([int(np.argmin(digests))])
    best, at = digests.copy(), np.arange(len(digests))
    reach = 1
    while reach < width:  # doubling: best[i] is the least of digests[i : i + reach]
        step = min(reach, width - reach)
        other, where = best[step:], at[step:]
        less = other < best[: len(other)]
        best, at = np.where(less, other, best[: len(other)]), np.where(less, where, at[: len(where)])
        reach += step
    return np.unique(at)


def around(picked: np.ndarray, reach: int, n: int) -> np.ndarray:
    """The places below n that are at most `reach` from a picked one."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(picked - reach, 0), 1)
    np.add.at(edge, np.minimum(picked + reach + 1, n), -1)
    return np.flatnonzero(np.cumsum(edge[:n]) > 0)


def units(raw: np.ndarray, offs: np.ndarray, run: int, min_line: int, copy: np.ndarray | None = None, repeated: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, digest, first word, words) of all units; of texts marked in `copy` the whole text only.

    With the filter `repeated`: the units that pass it, and all runs around the picked ones that do.
    """
    starts, ends, first = spans(raw, offs, NONSPACE)
    words = word_digests(raw, starts, ends)
    # lines: a word opens one if a line feed stands between it and the word before
    breaks = np.cumsum(np.concatenate([[0], raw == 10]))
    feeds = np.concatenate([[2], breaks[starts[1:]] - breaks[ends[:-1]]]) if len(starts) else np.zeros(0, np.int64)
    feeds[first[:-1][first[:-1] < len(starts)]] = 2
    heads = np.flatnonzero(feeds > 0)
    sizes = np.diff(np.append(heads, len(words)))
    doc_of = np.searchsorted(first, heads, "right") - 1
    full = np.flatnonzero(np.diff(first) > 0)
    copy = np.zeros(len(offs) - 1, bool) if copy is None else copy
    long = (sizes >= min_line) & ~copy[doc_of]
    parts = [  # whole texts, lines; then paragraphs and passages
        (full, stretches(words, first[full], first[full + 1]) ^ np.uint64(1), np.zeros(len(full), np.int64), np.diff(first)[full]),
        (doc_of[long], stretches(words, heads[long], heads[long] + sizes[long]) ^ np.uint64(2), heads[long] - first[doc_of[long]], sizes[long]),
    ]
    if min_line > 1 and len(heads):
        p_line = np.flatnonzero(feeds[heads] > 1)  # lines that open a paragraph
        p_head, p_doc = heads[p_line], doc_of[p_line]
        p_size = np.diff(np.append(p_head, len(words)))
        own = (np.minimum.reduceat(sizes, p_line) < min_line) & (p_size >= min_line) & (p_size < np.diff(first)[p_doc]) & ~copy[p_doc]
        p_head, p_size, p_doc = p_head[own], p_size[own], p_doc[own]
        parts.append((p_doc, stretches(words, p_head, p_head + p_size) ^ np.uint64(4), p_head - first[p_doc], p_size))
    grams = runs(words, run)
    if repeated is not None:
        parts = [tuple(x[kept] for x in part) for part in parts for kept in [passes(repeated, part[1])]]
    for d in np.flatnonzero((np.diff(first) >= run) & ~copy).tolist():
        own = grams[first[d] : first[d + 1] - run + 1]
        picked = winnow(own, run + 1)
        if repeated is not None:
            picked = around(picked[passes(repeated, own[picked] ^ np.uint64(3))], run, len(own))
        parts.append((np.full(len(picked), d), grams[first[d] + picked] ^ np.uint64(3), picked, np.full(len(picked), run)))
    doc, h, at, n = (np.concatenate(x) for x in zip(*parts))
    return doc, h, at.astype(np.int32), n.astype(np.int32)


def text_key(text: Column | str) -> Column:
    return F.xxhash64(text)


def find_units(docs: DataFrame, run: int, min_line: int, repeated=None) -> DataFrame:
    """The units of docs(doc_id, text, tk, copy); `repeated` is a broadcast filter."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            copy = np.asarray(batch.column(3)).astype(bool)
            for lo, hi, raw, offs in blocks(batch.column(1)):
                doc, h, at, n = units(raw, offs, run, min_line, copy[lo:hi], None if repeated is None else repeated.value)
                where = pa.array(doc + lo)
                yield pa.record_batch([pa.array(h.view(np.int64)), batch.column(0).take(where), batch.column(2).take(where), pa.array(at), pa.array(n)], names=["h", "doc_id", "tk", "at", "n"])

    return docs.select("doc_id", "text", "tk", "copy").mapInArrow(find, UNIT_SCHEMA)


def repeats(found: DataFrame) -> DataFrame:
    """h and the kept occurrence of the units that occur more than once."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tk", "at")
    return found.groupBy("h").agg(F.min(place).alias("f"), F.max(place).alias("l")).filter("f != l").select("h", F.col("f.doc_id").alias("f_doc"), F.col("f.tk").alias("f_tk"), F.col("f.at").alias("f_at"))


def mark_copies(rows: DataFrame) -> DataFrame:
    """Adds copy: a document of lower doc_id has the same text; a null id is above all others."""
    id_rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    kept = rows.groupBy("tk").agg(F.min(id_rank).alias("f"), F.max(id_rank).alias("l")).filter("f != l").select(F.col("tk").alias("k_tk"), F.col("f.doc_id").alias("k_doc"))
    marked = rows.join(shared_if_small(stored(kept, "copied-texts"), 16), F.col("tk") == F.col("k_tk"), "left")
    return marked.withColumn("copy", F.col("k_tk").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("k_doc"))).drop("k_tk", "k_doc")


def dedup_substrings(docs: DataFrame, *, run: int = 25, min_line: int = 25, whole_passages: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (what stays), n_words, n_removed, removed (spans of code points of the original text), and the columns to carry.

    Null text stays null and has no units; texts without words stay as they are.  Rows that agree in
    doc_id and text are one document and get the same result; a null doc_id ranks last.  Repeats inside
    one document count like repeats between documents.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    carried = F.struct(*map(F.col, carry)) if carry else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), carried.alias("carried")).withColumn("tk", text_key("text"))
    if whole_passages:
        marked = mark_copies(rows.select("doc_id", "text", "tk"))
        sampled = stored(repeats(find_units(marked, run, min_line)).select("h"), "repeated-samples")
        found = find_units(marked, run, min_line, spark.sparkContext.broadcast(digest_filter(sampled)))
    else:
        found = find_units(rows.withColumn("copy", F.lit(False)), run, min_line)
    firsts = stored(repeats(found), "repeated-units")  # so that a very common unit can be split in the join below
    same = F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("tk") == F.col("f_tk"))
    later = found.join(firsts, "h").filter(~same | (F.col("at") >= F.col("f_at") + F.col("n")))
    gone = later.groupBy(F.col("doc_id").alias("g_doc"), F.col("tk").alias("g_tk")).agg(F.collect_set(F.struct("at", "n")).alias("gone"))
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["g_doc"]) & (rows["tk"] == gone["g_tk"]), "left").select("doc_id", "text", "gone", "carried")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            raw, offs = utf8(batch.column(1))
            spot_offs = batch.column(2).offsets.to_numpy()
            spot_at, spot_n = (x.to_numpy() for x in batch.column(2).values.flatten())
            texts, n_words, n_gone, removed = [], [], [], []
            for i, spots in enumerate(slice(a, b) for a, b in zip(spot_offs[:-1].tolist(), spot_offs[1:].tolist())):
                own = raw[offs[i] : offs[i + 1]]
                starts, ends, _ = spans(own, np.array([0, len(own)]), NONSPACE)
                n_words.append(len(starts))
                if spots.start == spots.stop or not batch.column(1)[i].is_valid:
                    texts.append(batch.column(1)[i].as_py())
                    n_gone.append(0)
                    removed.append([])
                    continue
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, spot_at[spots], 1)
                np.add.at(cover, spot_at[spots] + spot_n[spots], -1)
                off = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
                a, b = np.flatnonzero(off[1:] & ~off[:-1]), np.flatnonzero(off[:-1] & ~off[1:])
                chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                parts, at = [], 0
                for x, y in zip(a.tolist(), b.tolist()):
                    parts.append(own[at : starts[x]].tobytes())
                    at = int(starts[y]) if y < len(starts) else len(own)
                parts.append(own[at:].tobytes())
                text = b"".join(parts).decode("utf-8")
                texts.append(text.rstrip(" \t\n\r\x0b\x0c") if at == len(own) else text)
                n_gone.append(int(off.sum()))
                removed.append([{"start": int(chars[starts[x]]), "end": int(chars[ends[y - 1]])} for x, y in zip(a.tolist(), b.tolist())])
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(removed, kind), batch.column(3)], names=["doc_id", "text", "n_words", "n_removed", "removed", "carried"])

    schema = T.StructType.fromDDL("doc_id long, text string, n_words long, n_removed long, removed array<struct<start: long, end: long>>").add(joined.schema["carried"])
    done = joined.mapInArrow(cut, schema)
    return done.select("doc_id", "text", "n_words", "n_removed", "removed", *([F.col("carried")[c].alias(c) for c in carry]))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's remaining text and the removed spans of the original."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_line=1, whole_passages=True)
