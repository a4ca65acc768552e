"""Packing by cutting-stock column generation.

Documents become token ids; whole multiples of the sequence length are cut off as full
sequences and each document leaves one remainder of 1..capacity-1 tokens.  Remainders fall
into length classes (`grain` tokens wide), and the histogram of the classes - a table whose
size depends on capacity/grain only - is the demand of a cutting-stock problem: a linear
program over patterns (how many remainders of each class share a sequence), whose columns an
unbounded knapsack prices by dynamic programming.  Rounded-down patterns are dealt to the
documents by their rank in their class; the few that rounding leaves - less than one copy of
each pattern, whatever the corpus - are placed by best fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm import output
from brindle.llm.tokens import CACHE_BYTES, encoder, without_gc
from brindle.sources.scratch import stored

#: Bytes of text that are tokenized at once (memory and speed only).
TEXT_BLOCK = 1 << 19
PIECE_SCHEMA = "part int, doc_id long, doc_tokens long, start long, length long, kind int, in_part long, ids_crc32 long, ids binary"


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value and counts of an unbounded knapsack whose item i weighs i + 1."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        options = best[room - 1 :: -1][: len(values)] + values[:room][: len(values)]
        i = int(np.argmax(options))
        if options[i] > best[room - 1] + 1e-12:
            best[room], take[room] = options[i], i
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(values), np.int64), capacity
    while room > 0:
        if (i := take[room]) < 0:
            room -= 1
        else:
            counts[i] += 1
            room -= i + 1
    return float(best[capacity]), counts


def column_generation(demand: np.ndarray, capacity: int, rounds: int = 2000, gap: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each; item i weighs i + 1 of capacity.

    Revised simplex: the basis starts with one single-class pattern for each class in demand, and
    the knapsack prices the next column.  The plan is at most `value` times as long as the best one;
    it ends when that is below 1 + gap, or after `rounds` columns (any basis is a feasible plan).
    """
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    m = len(used)
    basis = np.diag((capacity // (used + 1)).astype(float))
    inverse, x = np.linalg.inv(basis), demand[used] / np.diag(basis)
    for step in range(rounds):
        price = np.ones(m) @ inverse
        values = np.zeros(len(demand))
        values[used] = np.maximum(price, 0)
        value, counts = knapsack(values, capacity)
        if value <= 1 + gap:
            break
        column = inverse @ counts[used]
        ratio = np.where(column > 1e-9, x / np.where(column > 1e-9, column, 1), np.inf)
        row = int(np.argmin(ratio))
        if not np.isfinite(ratio[row]):
            break
        basis[:, row] = counts[used]
        theta = ratio[row]
        x = x - theta * column
        x[row] = theta
        x = np.maximum(x, 0)
        if step % 100 == 99:
            inverse = np.linalg.inv(basis)
        else:
            inverse[row] /= column[row]
            others = np.arange(m) != row
            inverse[others] -= np.outer(column[others], inverse[row])
    plan = []
    for j in range(m):
        counts = np.zeros(len(demand), np.int64)
        counts[used] = np.rint(basis[:, j]).astype(np.int64)
        plan.append((counts, float(x[j])))
    return plan


def deal(demand: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, int]:
    """(class, first rank, copies, count in a copy, first sequence) for each use of a class by a rounded pattern; ranks dealt; sequences."""
    plan, dealt, sequences = [], np.zeros(len(demand), np.int64), 0
    for counts, x in column_generation(demand, capacity):
        copies = int(x + 1e-9)
        copies = min([copies, *((demand - dealt)[counts > 0] // counts[counts > 0]).tolist()])
        if copies <= 0:
            continue
        for c in np.flatnonzero(counts).tolist():
            plan.append((c, int(dealt[c]), copies, int(counts[c]), sequences))
            dealt[c] += copies * counts[c]
        sequences += copies
    return plan, dealt, sequences


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, longest first into the fullest bin that has room."""
    from bisect import bisect_left, insort

    room: list[tuple[int, int]] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    bins = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = bisect_left(room, (lengths[i], -1))
        left, b = room.pop(k) if k < len(room) else (capacity, bins)
        bins += b == bins
        out[i] = (b, capacity - left)
        insort(room, (left - lengths[i], b))
    return out


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int, grain: int, end_id: int, id_col: str, text_col: str, with_ids: bool, cache_bytes: int = CACHE_BYTES, text_block: int = TEXT_BLOCK) -> DataFrame:
    """The pieces, stored: full sequences (kind -1) and at most one remainder for each document (kind: its length class).

    `in_part` counts the pieces of a kind within a partition, so that ranks need no sort of a whole class.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, cache_bytes), TaskContext.get().partitionId()
        seen = [0] * (-(-capacity // grain) + 1)
        with without_gc():
            for batch in batches:
                for lo, _, texts in output.text_blocks(batch.column(1), text_block):
                    names = batch.column(0)
                    cols: list[list] = [[] for _ in range(8)]
                    ids, offsets = output.with_end(*enc.encode(texts), end_id)
                    ends = offsets.tolist()
                    for i, (first, last) in enumerate(zip(ends[:-1], ends[1:])):
                        n = last - first
                        for start in range(0, n, capacity):
                            piece = ids[first + start : min(first + start + capacity, last)]
                            size = len(piece)
                            kind = -1 if size == capacity else (size - 1) // grain
                            for col, v in zip(cols, (lo + i, n, start, size, kind, seen[kind], zlib.crc32(piece), piece.tobytes() if with_ids else None)):
                                col.append(v)
                            seen[kind] += 1
                    yield pa.record_batch(
                        [pa.array([part] * len(cols[0]), pa.int32()), names.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[5:7]), pa.array(cols[7], pa.binary())],
                        names=["part", "doc_id", "doc_tokens", "start", "length", "kind", "in_part", "ids_crc32", "ids"],
                    )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(encode, PIECE_SCHEMA), "packing-pieces")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table sent as Arrow data: a list of rows would start Python workers of another kind on the executors."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in schema.split(", ")]
    columns = [list(c) for c in zip(*rows)] or [[] for _ in names]
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names), schema)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, grain: int = 8, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_bytes: int = CACHE_BYTES, text_block: int = TEXT_BLOCK) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Every id (the end id too) lies in exactly one piece; the pieces of a sequence are gapless from 0.
    Null text counts as empty (a document of the end id alone); a null doc_id is kept; rows with equal
    doc_id are separate documents; an empty table gives no rows.  A class's documents are ranked by the
    partition that stored them and their order in it.  ids: little-endian unsigned 32-bit, as binary.
    cache_bytes, text_block: what a worker remembers and tokenizes at once; both bear on memory and speed only.
    """
    spark = docs.sparkSession
    pieces = cut_documents(docs, tokenizer, capacity, grain, end_id, id_col, text_col, with_ids, cache_bytes, text_block)
    classes = -(-capacity // grain)
    # partitions x classes rows: where the ranks of each partition begin in each class
    counts = stored(pieces.groupBy("kind", "part").agg(F.count("*").alias("n")), "packing-counts")
    total = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # at most classes + 1 rows
    full = total.get(-1, 0)
    demand = np.array([total.get(c, 0) for c in range(classes)], np.int64)
    plan, dealt, sequences = deal(demand, classes)
    bases = counts.select("kind", "part", (F.sum("n").over(Window.partitionBy("kind").orderBy("part")) - F.col("n")).alias("rank0"))
    ranked = pieces.join(bases, ["kind", "part"]).withColumn("rank", F.col("rank0") + F.col("in_part"))
    if not with_ids:
        ranked = ranked.drop("ids")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    whole = ranked.filter("kind = -1").select("*", F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).select(out)
    # Patterns: at most `classes` of them, so these tables are bounded by capacity and grain.
    uses = _table(spark, plan, "kind int, rank_lo long, copies long, each long, first_seq long")
    n = F.col("rank") - F.col("rank_lo")
    in_pattern = (
        ranked.filter("kind >= 0").join(F.broadcast(uses), "kind").filter((n >= 0) & (n < F.col("copies") * F.col("each")))
        .withColumn("sequence_id", F.col("first_seq") + F.floor(n / F.col("each")) + full)
        .withColumn("offset", F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(out)
    )
    # What rounding left: less than one copy of each pattern, however large the corpus is.
    limits = _table(spark, [(c, int(d)) for c, d in enumerate(dealt)], "kind int, dealt long")
    left = ranked.filter("kind >= 0").join(F.broadcast(limits), "kind").filter("rank >= dealt")
    keys = left.select("kind", "rank", "length").orderBy("kind", "rank").collect()
    bins = best_fit([r["length"] for r in keys], capacity)
    fitted = _table(spark, [(r["kind"], r["rank"], full + sequences + b, o) for r, (b, o) in zip(keys, bins)], "kind int, rank long, sequence_id long, offset long")
    rest = left.join(F.broadcast(fitted), ["kind", "rank"]).select(out)
    return whole.unionByName(in_pattern).unionByName(rest)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: the packed sequences of pack(..., with_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "").alias("__hex")).select("sequence_id", "n_tokens", F.unhex("__hex").alias("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents packed into sequences of at most 4096 tokens; one row for each piece."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), cache_bytes=output.CACHE_BYTES, text_block=output.TEXT_BLOCK)
