"""Token-ID output: documents as Parquet rows of token ids in ascending doc_id order.

Files hold one row for each document: doc_id, n_tokens, at (ids of the file's earlier
documents), part (the file's place in the order) and ids, a list<int> column.  Rows are
sorted by doc_id and Parquet's row groups, pages and page index are set by parameters, so
a reader can fetch the metadata of all documents or the ids of a doc_id range without
touching other pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.tokens import encoder, give_back, without_gc
from brindle.llm.words import utf8
from brindle.sources.scratch import new_path

FILE_SCHEMA = "part int, doc_id long, at long, n_tokens long, ids array<int>"
#: op2_packing: bytes of chunks that a worker remembers (speed only), and of texts tokenized at once.
CACHE_BYTES = 240 << 20
TEXT_BLOCK = 1 << 22
#: write_token_ids: the same.  Each block hashes the table again, so a larger table costs more than it saves.
TABLE_BYTES = 16 << 20
LARGE_BLOCK = 1 << 23
#: Rows and ids of an Arrow batch that goes back to Spark.
OUT_ROWS, OUT_IDS = 1000, 1 << 20


def text_blocks(column: pa.Array, limit: int = TEXT_BLOCK) -> Iterator[tuple[int, int, pa.Array]]:
    """Row ranges of about `limit` bytes and their texts."""
    _, offs = utf8(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield lo, hi, column[lo:hi]
        lo = hi


def large_blocks(batches: Iterator[pa.RecordBatch], limit: int = LARGE_BLOCK) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of the same rows in their order, in blocks of up to `limit` bytes or one text, whatever the batches hold."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> tuple[pa.Array, pa.Array]:
        table = pa.Table.from_batches(held)
        return pa.concat_arrays(table.column(0).chunks), pa.concat_arrays(table.column(1).chunks)

    for batch in batches:
        for lo, hi, _ in text_blocks(batch.column(1), limit):
            rows = batch.slice(lo, hi - lo)
            more = int(pc.sum(pc.binary_length(rows.column(1))).as_py() or 0)
            if held and size + more > limit:
                yield block()
                held, size = [], 0
            held.append(rows)
            size += more
    if held:
        yield block()


def with_end(values: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of texts as Encoder.encode gives them, with end_id after each text."""
    return np.insert(values, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, *, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", row_group_mb: int = 32, page_kb: int = 256, partitions: int | None = None) -> None:
    """Encode every whole text, append end_id, and write ids in ascending doc_id order.

    encoding: "dictionary" or "delta" (DELTA_BINARY_PACKED).  Null text counts as empty; a null
    doc_id comes first; rows with equal doc_id stand together, in the order of their texts.  An empty
    table gives files without rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding: dictionary or delta")
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer, TABLE_BYTES), TaskContext.get().partitionId(), 0
        with without_gc():
            for names, texts in large_blocks(batches):
                values, offsets = with_end(*enc.encode(texts, large=True), end_id)
                lo, n = 0, len(names)
                while lo < n:
                    hi = min(n, lo + OUT_ROWS, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + OUT_IDS, "right")) - 1))
                    own = offsets[lo : hi + 1]
                    ids = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(values[own[0] : own[-1]].view(np.int32)))
                    yield pa.record_batch(
                        [pa.array(np.full(hi - lo, part, np.int32)), names[lo:hi], pa.array(at + own[:-1]), pa.array(np.diff(own)), ids],
                        names=["part", "doc_id", "at", "n_tokens", "ids"],
                    )
                    lo = hi
                at += int(offsets[-1])
                give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    out = rows.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "zstd").option("parquet.block.size", row_group_mb << 20).option("parquet.page.size", page_kb << 10)
    if encoding == "delta":
        out = out.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "v2")
    out.parquet(path)


def read_documents(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; a doc_id range reads only its pages.

    One row for each file is summed and shared with all tasks: as many rows as files.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    base = sums.select("part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("__base"))
    rows = files
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("__base") + F.col("at")).alias("start"), "n_tokens", "ids")


def ids_crc32(df: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Replace a list column of ids by the CRC-32 of its ids as little-endian unsigned 32-bit integers."""
    keep = [c for c in df.columns if c != ids_col]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            offs = np.asarray(column.offsets, np.int64)
            raw = np.ascontiguousarray(np.asarray(column.values, np.int32)).view(np.uint8)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offs[:-1], offs[1:])]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])

    kinds = dict(df.dtypes)
    return df.select(*keep, ids_col).mapInArrow(digest, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ids_crc32 long")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: per document doc_id, start, n_tokens, ids_crc32, read back from the written files."""
    import public_tokenizers

    path = new_path(spark, "token-ids")
    write_token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return ids_crc32(read_documents(spark, path))
