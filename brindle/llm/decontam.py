"""Benchmark decontamination by a distributed positional inverted index.

The index is cut by documents: each shard (some MB of text) is one stored row with the sorted
terms of its documents, their posting lists and the documents' places, so a phrase is
intersected inside one shard and no posting list crosses the network.  A test window is looked
up from its rarest term in the shard: that term's positions, shifted by its offset, are
intersected with the offset-adjusted lists of the other terms, rarest first.  With a tolerance
the same intersection gives proximity matches.  Terms are 64-bit digests of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.substring import digest_filter, passes, text_key
from brindle.llm.tokens import forget
from brindle.llm.words import ALNUM, blocks, spans, word_digests
from brindle.sources.scratch import stored

#: Bytes of text in a shard; one longer document makes a shard of its own.
SHARD = 2 << 20
#: Places left free after each document, so that no exact match crosses documents.
GAP = 64
#: Windows that one broadcast holds (about 100 bytes each); a larger test set is looked up block by block.
TEST_BLOCK = 1 << 17
INDEX_SCHEMA = "shard string, doc_ids array<bigint>, keys array<bigint>, n_words array<bigint>, places array<bigint>, terms array<bigint>, counts array<int>, positions binary"
_SHIFT = 40


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: np.ndarray | None = None) -> DataFrame:
    """One row for each shard.  Only terms that pass the filter `vocabulary` (None: all terms) get posting lists; keys: text_key of each text."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, raw, offs in blocks(batch.column(1), SHARD):
                starts, ends, first = spans(raw, offs, ALNUM)
                n_words = np.diff(first)
                places = np.concatenate([[0], np.cumsum(n_words + GAP)])[:-1]
                terms = word_digests(raw, starts, ends)
                at = np.arange(len(terms)) + np.repeat(places - first[:-1], n_words)
                if words is not None and len(terms):
                    keep = passes(words.value, terms)
                    terms, at = terms[keep], at[keep]
                order = np.argsort(terms, kind="stable")
                terms, at = terms[order], at[order]
                heads = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
                counts = np.diff(np.append(heads, len(terms)))
                made += 1
                row = {
                    "shard": f"{part}-{made}", "doc_ids": batch.column(0)[lo:hi].to_pylist(), "keys": batch.column(2)[lo:hi].to_pylist(), "n_words": n_words, "places": places, "terms": terms[heads].view(np.int64), "counts": counts.astype(np.int32),
                    "positions": at.astype("<u4" if len(at) == 0 or at[-1:].max() < 2**32 else "<u8").tobytes(),
                }
                kinds = [pa.string()] + [pa.list_(pa.int64())] * 5 + [pa.list_(pa.int32()), pa.binary()]
                yield pa.record_batch([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("key", text_key("text")).mapInArrow(index, INDEX_SCHEMA)


@dataclass
class Windows:
    """Test windows: term digests (padded with 0), lengths, and the id of each one's item."""

    terms: np.ndarray
    lengths: np.ndarray
    items: list[str]


def windows(benchmark: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, terms, block, stored: all runs of `size` words of each item, each once; an item of fewer words, but not none, is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offs in blocks(batch.column(1)):
                starts, ends, first = spans(raw, offs, ALNUM)
                digest = word_digests(raw, starts, ends).view(np.int64)
                n = np.diff(first)
                made = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
                item = np.repeat(np.arange(hi - lo), made)
                begin = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(made) - made, made)
                length = np.minimum(n[item], size)
                offsets = np.concatenate([[0], np.cumsum(length)])
                where = np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])
                yield pa.record_batch([batch.column(0).take(pa.array(item + lo)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(digest[where]))], names=["item", "terms"])

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    made = stored(rows.mapInArrow(cut, "item string, terms array<bigint>").distinct(), "windows")
    blocks_ = max(1, -(-made.count() // TEST_BLOCK))
    return made.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(blocks_)))


def read_block(table: DataFrame, block: int, size: int) -> Windows:
    """One block of windows, about TEST_BLOCK of them."""
    got = table.filter(F.col("block") == block).select("item", "terms").toArrow().combine_chunks()
    terms = np.zeros((got.num_rows, size), np.uint64)
    lists = got.column("terms").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(np.asarray(lists.offsets, np.int64))
    terms[np.arange(size) < lengths[:, None]] = np.asarray(lists.flatten(), np.int64).view(np.uint64)
    return Windows(terms, lengths, got.column("item").to_pylist())


def matches(win: Windows, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, places: np.ndarray, n_words: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, place, document) of each match: all terms stand at their places, or within `slop` of them, in the document of the rarest one."""
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(win.terms):
        return none, none, none
    lists = np.minimum(np.searchsorted(terms, win.terms), len(terms) - 1)
    real = np.arange(win.terms.shape[1]) < win.lengths[:, None]
    alive = np.flatnonzero(((terms[lists] == win.terms) | ~real).all(axis=1))
    if not len(alive):
        return none, none, none
    key = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << _SHIFT) | positions
    begin = np.concatenate([[0], np.cumsum(counts)])
    lists, real = lists[alive], real[alive]
    sizes = np.where(real, counts[lists], np.iinfo(np.int64).max)
    order = np.argsort(sizes, axis=1, kind="stable")
    rarest = order[:, 0]
    each = sizes[np.arange(len(alive)), rarest]
    found_w, found_p, found_d = [], [], []
    lo = 0
    total = np.cumsum(each)
    while lo < len(alive):  # at most about a million places at once
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 1_000_000, "right")))
        n = each[lo:hi]
        w = np.repeat(np.arange(lo, hi), n)
        inside = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        anchor = positions[begin[lists[w, rarest[w]]] + inside]
        doc, place = np.searchsorted(places, anchor, "right") - 1, anchor - rarest[w]
        for step in range(1, order.shape[1]):
            if not len(w):
                break
            j = order[w, step]
            low = np.maximum(place + j - slop, places[doc])
            high = np.minimum(place + j + slop, places[doc] + n_words[doc] - 1)
            target = (lists[w, j].astype(np.int64) << _SHIFT) | low
            got = key[np.minimum(np.searchsorted(key, target), len(key) - 1)]
            ok = ((low <= high) & (got >= target) & (got <= ((lists[w, j].astype(np.int64) << _SHIFT) | np.maximum(high, 0)))) | ~real[w, j]
            w, place, doc = w[ok], place[ok], doc[ok]
        found_w.append(alive[w])
        found_p.append(place)
        found_d.append(doc)
        lo = hi
    return np.concatenate(found_w), np.concatenate(found_p), np.concatenate(found_d)


def look_up(index: DataFrame, win: Windows, slop: int) -> DataFrame:
    """For each document of the index: row (its place in the index), doc_id, key (of its text), n_words, hit (places of words inside exact matches), items, near (items that match by proximity only)."""
    test = index.sparkSession.sparkContext.broadcast(win)
    out = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("hit", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = test.value
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, keys, n_words, places, terms, counts = (batch.column(c)[i].values for c in range(1, 7))
                n_words, places = np.asarray(n_words, np.int64), np.asarray(places, np.int64)
                terms, counts = np.asarray(terms, np.int64).view(np.uint64), np.asarray(counts, np.int64)
                raw = batch.column(7)[i].as_buffer()
                positions = np.frombuffer(raw, "<u4" if raw.size == 4 * counts.sum() else "<u8").astype(np.int64)
                hits, items, near = [[] for _ in range(len(n_words))], [[] for _ in range(len(n_words))], [[] for _ in range(len(n_words))]
                w, place, doc = matches(win, terms, counts, positions, places, n_words)
                for d in np.unique(doc):
                    own = doc == d
                    covered = np.zeros(n_words[d] + 1, np.int64)
                    at = place[own] - places[d]
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + win.lengths[w[own]], -1)
                    hits[d] = np.flatnonzero(np.cumsum(covered)[:-1] > 0).tolist()
                    items[d] = sorted({win.items[x] for x in w[own].tolist()})
                if slop:
                    w, place, doc = matches(win, terms, counts, positions, places, n_words, slop)
                    for d, x in sorted({(d, win.items[x]) for d, x in zip(doc.tolist(), w.tolist())}):
                        if x not in items[d]:
                            near[d].append(x)
                shard = batch.column(0)[i].as_py()
                yield pa.record_batch([pa.array([f"{shard}-{d}" for d in range(len(hits))]), pa.array(doc_ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(n_words), *(pa.array(x, pa.list_(k)) for x, k in ((hits, pa.int64()), (items, pa.string()), (near, pa.string())))], schema=out)

    return index.mapInArrow(search, "row string, doc_id long, key long, n_words long, hit array<bigint>, items array<string>, near array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row for each document: doc_id, key (text_key of its text), n_words, hit, items, near (proximity matches only, for slop > 0).

    Null and empty texts have no words and no hits; items without words match nothing; repeated
    items count once by their id; rows with equal doc_id each get a row.  An empty table gives no
    rows, an empty test set no hits.  A match, exact or near, lies in one document.  Windows are cut
    on the executors and read in blocks; the matches of several blocks are merged per document.
    """
    table = windows(benchmark, size, item_col)
    vocabulary = digest_filter(table.select(F.explode("terms").alias("h")).distinct())
    index = stored(build_index(docs, id_col, text_col, vocabulary), "postings")
    blocks_ = table.select(F.max("block")).first()[0] or 0
    found = look_up(index, read_block(table, 0, size), slop)
    if not blocks_:
        return found.drop("row")
    for block in range(1, blocks_ + 1):
        found = found.unionByName(look_up(index, read_block(table, block, size), slop))
    merge = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  a document's own matches
    merged = found.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "key", "n_words")], merge("hit").alias("hit"), merge("items").alias("items"), merge("near").alias("near"))
    return merged.select("doc_id", "key", "n_words", "hit", "items", F.array_except("near", "items").alias("near"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the contract's columns for whole documents against the whole benchmark."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )
