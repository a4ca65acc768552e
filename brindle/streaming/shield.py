"""Leakage shield and near-duplicate removal on streams.

The shield is stateless: a stream-static left anti join for each LSH band against the bands of the test set, which a
size check allows to be broadcast.

Removal of near-duplicates keeps what the sequential loop over arrivals keeps.  A document's bands lie under different
keys, and one of them decides for all, so no operator keyed by band can decide alone; each micro-batch is settled by
the batch operator instead: documents that share a band with one kept before go, the rest are reduced to a fixpoint
among themselves.  The state is a table of the kept documents' bands, one folder for each micro-batch, replaced whole
if the micro-batch runs again, so a restart from the checkpoint neither loses nor doubles anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import near_dup as N
from brindle.plans import corpus_queries as CQ
from brindle.sources.scratch import new_path, shared_if_small, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def shield_stream(stream: DataFrame, test_index: DataFrame, threshold: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of a stream (or table) that share no band with the test index(band, band_hash); candidates are not verified.

    A text without shingles has no bands and stays.  The index is static: it is read and stored once, when the stream is
    defined.  id_col must be a column of the stream; other columns pass through.
    """
    b, r = N.BANDS[threshold]
    index = stored(test_index.select("band", "band_hash", *[c for c in test_index.columns if c == "head"]).distinct(), "test-index")
    signed = _signed(stream, text_col, N.band_heads(index, threshold))
    banded = signed.withColumn("__bands", F.when(F.col("__sig")[0] < N.PRIME, F.array(*[F.md5(F.array_join(F.slice("__sig", 1 + i * r, r), ",")) for i in range(b)])))
    for i in range(b):
        own = shared_if_small(index.filter(F.col("band") == i).select(F.col("band_hash").alias("__hit")), 48)
        banded = banded.join(own, F.col("__bands")[i] == F.col("__hit"), "left_anti")
    return banded.select(*stream.columns)


def _signed(df: DataFrame, text_col: str, near: tuple | None) -> DataFrame:
    """df with __sig; its own columns travel in one struct beside the text.  A row that cannot meet the heads `near` counts as one without shingles."""
    whole = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("__own"), F.col(text_col).alias("__text"))
    return N.signatures(whole, id_col="__own", text_col="__text", sig_col="__sig", near=near).select("__own.*", "__sig")


def file_stream(spark: SparkSession, source: str, files_at_once: int | None = None) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream."""
    schema = spark.read.parquet(source).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(source) if folder else reader.option("pathGlobFilter", path.getName()).parquet(str(path.getParent()))


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """All that the source holds now, appended as Parquet; a later call with the same checkpoint goes on from there."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def settle_batch(state: str, out: str, threshold: float = 0.85, *, id_col: str = "doc_id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows with `kept` go to out/batch=n, the bands of the kept ones to state/batch=n.

    The ids of one stream are distinct and comparable; within a micro-batch the smaller id comes first.
    Rows without an id are kept.
    """

    def settle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = stored(batch, "micro-batch")
        index = stored(N.lsh_index(rows.filter(F.col(id_col).isNotNull()), threshold, id_col=id_col).select(F.col(id_col).alias("id"), F.concat_ws("-", "band", "band_hash").alias("bucket")), "micro-batch-bands")
        live = index
        if _exists(spark, state):
            before = spark.read.schema(f"{index.schema.fields[0].simpleString().replace(':', ' ')}, bucket string, batch long").parquet(state).filter(F.col("batch") < number)
            hit = index.join(before.select("bucket"), "bucket", "left_semi").select("id").distinct()
            live = stored(index.join(shared_if_small(stored(hit, "met-before"), 16), "id", "left_anti"), "micro-batch-live")
        kept = stored(N.greedy_buckets(live), "micro-batch-kept")
        live.join(kept, "id", "left_semi").select("id", "bucket").write.mode("overwrite").parquet(f"{state}/batch={number}")
        gone = shared_if_small(stored(index.select("id").distinct().join(kept, "id", "left_anti").select(F.col("id").alias("__gone")), "micro-batch-gone"), 16)
        flagged = rows.join(gone, rows[id_col] == gone["__gone"], "left").withColumn("kept", F.col("__gone").isNull()).drop("__gone")
        flagged.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return settle


def dedup_stream(stream: DataFrame, out: str, state: str, checkpoint: str, threshold: float = 0.85, *, id_col: str = "doc_id") -> None:
    """All that the source holds now, in micro-batches, with `kept`; a later call with the same folders goes on from there."""
    stream.writeStream.foreachBatch(settle_batch(state, out, threshold, id_col=id_col)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_shield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 on a stream of the documents against the benchmark."""
    index = N.lsh_index(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 0.80, id_col="item_id")
    out = new_path(spark, "shielded")
    run_once(shield_stream(file_stream(spark, f"{sf_dir}/documents.parquet"), index), out, new_path(spark, "shielded-state"))
    return spark.read.parquet(out).select("doc_id")


def arrivals(df: DataFrame, path: str, order: str, parts: int) -> Iterator[None]:
    """Append the rows of df to a folder in parts that follow each other in the order of a column; a stream reads between two of them.

    All cores write each part, so it may be many files.  Rows without a value are in the first part.
    """
    bounds = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = df if low is None else df.filter(F.col(order) > low)
        if high is not None:
            part = part.filter((F.col(order) <= high) | F.col(order).isNull() if low is None else F.col(order) <= high)
        part.write.mode("append").parquet(path)
        yield


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 on a stream: documents arrive four times in the order of their ids, one micro-batch each."""
    source, out, state, checkpoint = (new_path(spark, x) for x in ("arrivals", "stream-dedup", "stream-dedup-bands", "stream-dedup-state"))
    for _ in arrivals(spark.read.parquet(f"{sf_dir}/documents.parquet"), source, "doc_id", 4):
        dedup_stream(file_stream(spark, source), out, state, checkpoint)
    return spark.read.parquet(out).select("doc_id", "kept")


QUERIES["stream_shield"], ORACLES["stream_shield"] = stream_shield, CQ.ORACLES["leakage_filter"]
QUERIES["stream_dedup"], ORACLES["stream_dedup"] = stream_dedup, CQ.ORACLES["minhash_dedup"]
