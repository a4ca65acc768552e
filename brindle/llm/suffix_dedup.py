"""Exact removal of repeated substrings by blockwise suffix sorting with difference-cover samples.

Every suffix counts by its first WIDTH bytes, its window.  The bucket of a window is the least GRAM-byte string in it
(by hash; the first of equals), so equal windows lie in one bucket at one place of that string.  Neighbouring windows
of one bucket travel as one stretch of text, some 3.5 bytes a window; equal stretches are counted before they move.

1. The buckets of all texts are counted; windows of a bucket that occurs once have no equal.  A filter of the others
   goes to the second reading, which writes their stretches.
2. Stretches meet by bucket and buckets are sorted one at a time, in blocks of about BLOCK bytes.  A stretch lies in its
   block so that its bucket's string begins at a multiple of PERIOD.  The samples, at the residues of a difference cover
   of PERIOD, are ranked first, by SAMPLE bytes; the windows are then sorted by their first 8 bytes, ties by the ranks of
   their first and last samples, and by the last 8 bytes: together all of the window.  What keeps one bucket's windows
   apart takes memory for a third of its bytes only, however long the ties.
3. Of equal windows the first by document and place is the earliest; a stretch gets the runs of windows that have an
   earlier one, and each of its occurrences the bytes that these cover.

A bucket with very many different stretches (a common phrase in many contexts) is cut again by another hash, until its
parts are small: no bucket must fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.substring import digest_filter, passes
from brindle.llm.tokens import forget
from brindle.llm.words import mix, utf8
from brindle.sources.scratch import shared_if_small, stored

WIDTH, GRAM = 100, 20
PERIOD, COVER = 13, (0, 1, 3, 9)  # any two residues have an offset at which both are in the cover
SAMPLE = WIDTH - PERIOD + 1
#: Bytes of text cut or sorted at once.
BLOCK = 1 << 20
#: Stretches of one bucket that are sorted together, and how often a larger bucket is cut again.
MOST, LEVELS = 4096, 6
CUT_SCHEMA = "h long, o long, tk long, pos long, pk int, s binary"
_GREATEST = (1 << 63) - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SPOT = np.uint64((1 << 20) - 1)


def words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one little-endian number (zeros beyond the end)."""
    x = np.zeros(len(raw) + 8, np.uint64)
    x[: len(raw)] = raw
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        x[:-step] |= x[step:] << np.uint64(bits)
    return x


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on (fewer than GRAM bytes: none)."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = words_at(raw)
    return mix(mix(x[:n]) * _A + x[8 : n + 8] * _B + (x[16 : n + 16] & np.uint64(0xFFFFFFFF)) * _C)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    grid = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(values)] = values
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(raw: np.ndarray, offs: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first window, last window, place of the bucket's string) of all stretches of the texts, at most 2^20 bytes."""
    h = gram_hashes(raw)
    order = h if not level else mix(h + np.uint64(level) * _C)
    spots = least((order & ~_SPOT) | np.arange(len(h), dtype=np.uint64), WIDTH - GRAM + 1)
    edge = np.zeros(len(raw) + 1, np.int32)
    full = np.flatnonzero(np.diff(offs) >= WIDTH)
    np.add.at(edge, offs[full], 1)
    np.add.at(edge, offs[full + 1] - WIDTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    spot = (spots[windows] & _SPOT).astype(np.int64)
    cuts = np.flatnonzero((np.diff(windows) != 1) | (np.diff(spot) != 0)) + 1
    first, last = np.concatenate([[0], cuts]), np.append(cuts, len(windows)) - 1
    return h[spot[first]], windows[first], windows[last], spot[first]


def pieces(column: pa.Array, reach: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row, place in the row's text) of parts of at most `reach` bytes; every window of a long text is in one of its parts."""
    raw, offs = utf8(column)
    held: list[tuple[int, int, int]] = []
    size = 0

    def block():
        parts = np.array(held, np.int64)
        return np.concatenate([raw[offs[r] + a : offs[r] + b] for r, a, b in held]), np.concatenate([[0], np.cumsum(parts[:, 2] - parts[:, 1])]), parts[:, 0], parts[:, 1]

    for row, n in enumerate(np.diff(offs).tolist()):
        at = 0
        while n - at >= WIDTH:
            end = min(n, at + reach)
            if held and size + end - at > reach:
                yield block()
                held, size = [], 0
            held.append((row, at, end))
            size += end - at
            at = end - WIDTH + 1
    if held:
        yield block()


def binary(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """raw[first[i]:end[i]] as a binary column."""
    sizes = end - first
    offs = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(first - offs[:-1], sizes) + np.arange(offs[-1])
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(raw[at])])


def counted_buckets(docs: DataFrame) -> DataFrame:
    """h of the buckets that occur more than once in docs(text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for raw, offs, _, _ in pieces(batch.column(0)):
                h, c = np.unique(stretches(raw, offs)[0], return_counts=True)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c.astype(np.int32))], names=["h", "c"])

    return docs.select("text").mapInArrow(count, "h long, c int").groupBy("h").agg(F.sum("c").alias("c")).filter("c > 1").select("h")


def cut_texts(docs: DataFrame, repeated) -> DataFrame:
    """The stretches of docs(o, tk, text) whose bucket passes the broadcast filter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for raw, offs, rows, base in pieces(batch.column(2)):
                h, first, last, spot = stretches(raw, offs)
                live = passes(repeated.value, h)
                h, first, last, spot = h[live], first[live], last[live], spot[live]
                piece = np.searchsorted(offs, first, "right") - 1
                where = pa.array(rows[piece])
                yield pa.record_batch([pa.array(h.view(np.int64)), batch.column(0).take(where), batch.column(1).take(where), pa.array(base[piece] + first - offs[piece]), pa.array((spot - first).astype(np.int32)), binary(raw, first, last + WIDTH)], names=["h", "o", "tk", "pos", "pk", "s"])

    return docs.select("o", "tk", "text").mapInArrow(cut, CUT_SCHEMA)


def cut_again(strings: DataFrame, level: int) -> DataFrame:
    """The stretches of larger buckets' strings in buckets of another hash: h, o, tk, pos, pk, s, and their parent's g, own place in it (off) and number n."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            parent, o, tk, pos, n, g = (batch.column(names.index(c)) for c in ("h", "o", "tk", "pos", "n", "g"))
            column = batch.column(names.index("s"))
            raw = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
            offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            lo = 0
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BLOCK, "right")) - 1)
                part, own = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                h, first, last, spot = stretches(part, own, level)
                row = np.searchsorted(own, first, "right") - 1
                where, off = pa.array(row + lo), first - own[row]
                key = mix(np.asarray(parent, np.int64).view(np.uint64)[row + lo] * _B + h)
                yield pa.record_batch([
                    pa.array(key.view(np.int64)), o.take(where), tk.take(where), pa.array(np.asarray(pos, np.int64)[row + lo] + off), pa.array((spot - first).astype(np.int32)), binary(part, first, last + WIDTH), g.take(where), pa.array(off.astype(np.int32)), n.take(where),
                ], names=["h", "o", "tk", "pos", "pk", "s", "parent", "off", "n"])
                lo = hi

    return strings.mapInArrow(cut, CUT_SCHEMA + ", parent binary, off int, n long")


def collapsed(cuts: DataFrame, n) -> DataFrame:
    """One row for each different stretch g: its bucket, text, first occurrence and number."""
    first = F.min(F.struct("o", "tk", "pos")).alias("f")
    return cuts.groupBy("g").agg(F.any_value("h").alias("h"), F.any_value("pk").alias("pk"), F.any_value("s").alias("s"), first, n.alias("n")).select("h", "g", "pk", "s", "f.o", "f.tk", "f.pos", "n")


def with_digest(cuts: DataFrame) -> DataFrame:
    return cuts.withColumn("g", F.unhex(F.substring(F.sha2("s", 256), 1, 32)))


def sort_block(h: np.ndarray, pk: np.ndarray, doc: tuple[np.ndarray, np.ndarray, np.ndarray], n: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(stretch, first window, last window, stretch of the earliest equal windows) of runs that repeat; stretches in order of `doc`."""
    sizes = np.diff(offs)
    # each stretch begins where its bucket's string comes to a multiple of PERIOD
    room = -(-(sizes + PERIOD) // PERIOD) * PERIOD
    base = np.cumsum(room) - room + (-pk) % PERIOD
    text = np.zeros(int(room.sum()) + PERIOD + WIDTH, np.uint8)
    text[np.repeat(base - offs[:-1], sizes) + np.arange(offs[-1])] = raw
    eight = words_at(text).byteswap()
    # ranks of the samples, by SAMPLE bytes
    inside = np.zeros(len(text) + 1, np.int32)
    np.add.at(inside, base, 1)
    np.add.at(inside, base + sizes - SAMPLE + 1, -1)
    sampled = np.isin(np.arange(PERIOD), COVER)
    at = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & np.tile(sampled, len(text) // PERIOD + 1)[: len(text)])
    keys = [eight[at + j] for j in range(0, SAMPLE, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.zeros(len(text), np.int64)
    rank[at[order]] = np.cumsum(new)
    # windows, in order of their stretches
    count = sizes - WIDTH + 1
    stretch = np.repeat(np.arange(len(sizes)), count)
    t = np.arange(len(stretch)) - np.repeat(np.cumsum(count) - count, count)
    w = base[stretch] + t
    ahead = np.array([next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])
    final = np.array([next(d for d in range(WIDTH - SAMPLE, -1, -1) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])
    assert ahead.max() <= 8 and (final + SAMPLE).min() >= WIDTH - 8  # the parts cover the window
    r = w % PERIOD
    bucket = np.unique(h, return_inverse=True)[1][stretch] * WIDTH + (pk[stretch] - t)
    keys = [bucket, eight[w], rank[w + ahead[r]], rank[w + final[r]], eight[w + WIDTH - 8]]
    order = np.lexsort(keys[::-1])  # stable: of equal windows the earliest comes first
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    lead = np.empty(len(order), np.int64)
    lead[order] = stretch[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    cut = np.concatenate([[True], (np.diff(stretch) != 0) | (np.diff(lead) != 0)]) if len(lead) else np.zeros(0, bool)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(lead)) - 1
    live = (lead[first] != stretch[first]) | (n[stretch[first]] > 1)
    first, last = first[live], last[live]
    return stretch[first], t[first], t[last], lead[first]


def sort_buckets(strings: DataFrame) -> DataFrame:
    """g, t0, t1, e_o, e_tk, e_pos: runs of windows t0 to t1 of a stretch and where the earliest window equal to t0 stands.

    Runs of the earliest windows themselves are there for stretches that occur again.
    """

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()

        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            h, pk, o, tk, pos, n = (table.column(c).to_numpy() for c in ("h", "pk", "o", "tk", "pos", "n"))
            by = np.lexsort([pos + pk, tk, o])
            h, pk, o, tk, pos, n = (x[by].astype(np.int64) for x in (h, pk, o, tk, pos, n))
            s = table.column("s").take(pa.array(by)).combine_chunks()
            s = s.chunk(0) if isinstance(s, pa.ChunkedArray) else s
            offs = np.frombuffer(s.buffers()[1], np.int32)[s.offset : s.offset + len(s) + 1].astype(np.int64)
            raw = np.frombuffer(s.buffers()[2], np.uint8)[offs[0] : offs[-1]]
            stretch, t0, t1, lead = sort_block(h, pk, (o, tk, pos), n, raw, offs - offs[0])
            e_pos = pos[lead] + pk[lead] - pk[stretch] + t0
            return pa.record_batch([table.column("g").combine_chunks().take(pa.array(by[stretch])), pa.array(t0.astype(np.int32)), pa.array(t1.astype(np.int32)), pa.array(o[lead]), pa.array(tk[lead]), pa.array(e_pos)], names=["g", "t0", "t1", "e_o", "e_tk", "e_pos"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            heads = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
            if held and held[-1].column(0)[held[-1].num_rows - 1].as_py() == int(h[0]):
                heads = heads[1:]
            column = batch.column(3)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            at = 0
            for head in [*heads.tolist(), None]:  # a block ends between two buckets
                to = batch.num_rows if head is None else head
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size, at = size + int(ends[to] - ends[at]), to
                if head is not None and size >= BLOCK:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return strings.select("h", "g", "pk", "s", "o", "tk", "pos", "n").repartition("h").sortWithinPartitions("h").mapInArrow(resolve, "g binary, t0 int, t1 int, e_o long, e_tk long, e_pos long")


def earliest(strings: DataFrame, most: int = MOST, level: int = 1) -> DataFrame:
    """sort_buckets of all strings; buckets of more than `most` strings are cut again first."""
    hot = stored(strings.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("h"), "large-buckets")
    if level > LEVELS or hot.isEmpty():
        return sort_buckets(strings)
    hot = shared_if_small(hot, 16)
    again = stored(with_digest(cut_again(strings.join(hot, "h", "left_semi").select("h", "g", "s", "o", "tk", "pos", "n"), level)), "cut-again")
    inner = earliest(stored(collapsed(again, F.sum("n")), "strings-again"), most, level + 1)
    back = again.select(F.col("g"), F.col("parent"), "off").distinct().join(inner, "g")
    back = back.select(F.col("parent").alias("g"), (F.col("t0") + F.col("off")).alias("t0"), (F.col("t1") + F.col("off")).alias("t1"), "e_o", "e_tk", "e_pos")
    return sort_buckets(strings.join(hot, "h", "left_anti")).unionByName(back)


def dedup_suffixes(docs: DataFrame, *, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (spans of bytes: start, end), kept (the remaining bytes), of every row of docs.

    A byte goes if a WIDTH-byte string over it also starts earlier: in a document of smaller id, or before in the same
    one; matches never cross documents.  Null text is empty.  A null id ranks as the greatest; of different texts with
    one id the order is that of a hash; rows that agree in id and text are one document and get the same result.  Other
    columns are not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_GREATEST)).alias("o"), F.xxhash64(text).alias("tk"), text.alias("text"))
    copied = rows.select("o", "tk", F.unhex(F.sha2("text", 256)).alias("k_t")).groupBy("k_t").agg(F.min("o").alias("k_o"), F.max("o").alias("l_o"), F.min("tk").alias("k_tk")).filter("k_o < l_o")
    copies = shared_if_small(stored(copied.select("k_tk", "k_o", "k_t"), "copied-texts"), 64)
    same = (F.col("tk") == F.col("k_tk")) & (F.unhex(F.sha2("text", 256)) == F.col("k_t"))
    marked = rows.join(copies, same, "left").withColumn("copy", F.coalesce(F.col("o") > F.col("k_o"), F.lit(False))).drop("k_tk", "k_o", "k_t")
    own = marked.filter(~F.col("copy")).select("o", "tk", "text")
    repeated = spark.sparkContext.broadcast(digest_filter(stored(counted_buckets(own), "repeated-buckets")))
    cuts = stored(with_digest(cut_texts(own, repeated)), "stretches")
    runs = stored(earliest(stored(collapsed(cuts, F.count("*")), "strings"), most), "earliest-windows")
    start = F.col("pos") + F.col("t0")
    earlier = (F.col("e_o") < F.col("o")) | ((F.col("e_o") == F.col("o")) & ((F.col("e_tk") < F.col("tk")) | ((F.col("e_tk") == F.col("tk")) & (F.col("e_pos") < start))))
    gone = cuts.select("g", "o", "tk", "pos").join(runs, "g").filter(earlier).groupBy(F.col("o").alias("g_o"), F.col("tk").alias("g_tk")).agg(F.collect_set(F.struct(start.alias("start"), (F.col("pos") + F.col("t1") + WIDTH).alias("end"))).alias("gone"))
    joined = marked.join(gone, (F.col("o") == F.col("g_o")) & (F.col("tk") == F.col("g_tk")), "left").select("doc_id", "text", "copy", "gone")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            raw, offs = utf8(batch.column(1))
            spans = batch.column(3).flatten().flatten()
            start, end = (x.to_numpy() for x in spans)
            lists = batch.column(3)
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            to = np.cumsum(sizes)
            removed, kept = [], []
            for i, copy in enumerate(batch.column(2).to_pylist()):
                text, n = raw[offs[i] : offs[i + 1]], int(offs[i + 1] - offs[i])
                if copy:
                    a, b = (np.array([0]), np.array([n])) if n >= WIDTH else (np.zeros(0, np.int64),) * 2
                else:
                    of = slice(to[i] - sizes[i], to[i])
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, start[of], 1)
                    np.add.at(cover, end[of], -1)
                    off = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
                    a, b = np.flatnonzero(off[1:] & ~off[:-1]), np.flatnonzero(off[:-1] & ~off[1:])
                removed.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
                edges = np.concatenate([[0], np.column_stack([a, b]).ravel(), [n]])
                kept.append(b"".join(text[x:y].tobytes() for x, y in zip(edges[::2].tolist(), edges[1::2].tolist())))
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offs)), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's bytes, removed bytes and runs, and the digest of what remains."""
    found = dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
