"""Exact nearest neighbours by cosine, with cells that bounds rule out.

Centroids are a bounded sample of the pool; each row belongs to the one of least angle.  Rows and queries lie in blocks
of one cell each, with the largest angle to its centroid, stored in the shared folder.  By the triangle inequality no
pair of two blocks is closer than the angle of the centroids less both radii.  Pairs of blocks are first joined by
their heads alone (cells, radii); the vectors follow only for pairs that the bound leaves: in the first round the most
promising block of each query block, then all that could still beat the k-th best of one of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.sources.scratch import shared_if_small, stored

CELLS, BLOCK_ROWS, BLOCK_QUERIES = 64, 1024, 256
#: So many pairs of blocks meet at once, without a first round: bounds save nothing on so little.
FEW_PAIRS = 64
BLOCKS = "block long, cell int, n int, radius double, ids array<long>, v array<double>"


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v of the rows with an id and a vector of finite components."""
    v = F.col(vec_col)
    sound = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(-1, dims)


def angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Angles of rows and centroids; a row of zeros stands at a right angle to all."""
    size = np.sqrt((x * x).sum(axis=1))[:, None]
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    return np.arccos(np.clip(unit @ centroids.T, -1.0, 1.0))


def blocks(rows: DataFrame, centroids: np.ndarray, size: int, name: str) -> DataFrame:
    """Stored blocks of at most `size` rows of one cell; radius: the largest angle to the centroid (a right angle more for rows of zeros)."""
    dims = centroids.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = angles(matrix(batch.column(1), dims), centroids).argmin(axis=1).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(cell)], names=["id", "v", "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, number, cell = 0, TaskContext.get().partitionId() << 32, None

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            x = matrix(table.column("v").combine_chunks(), dims)
            radius = angles(x, centroids[cell : cell + 1])[:, 0]
            radius = np.where((x * x).sum(axis=1) > 0, radius, np.pi)
            one = lambda a, kind: pa.array([a], pa.list_(kind))
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([cell], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([float(radius.max())]), one(table.column("id").to_numpy(), pa.int64()), one(x.ravel(), pa.float64())], names=["block", "cell", "n", "radius", "ids", "v"])

        for batch in batches:
            cells = batch.column(2).to_numpy()
            ends = np.append(np.flatnonzero(np.diff(cells)) + 1, len(cells))
            at = 0
            while at < batch.num_rows:
                if n and (cells[at] != cell or n == size):
                    yield out()
                    held, n, number = [], 0, number + 1
                cell = int(cells[at])
                end = min(int(ends[np.searchsorted(ends, at, "right")]), at + size - n)
                held.append(batch.slice(at, end - at))
                n, at = n + end - at, end
        if n:
            yield out()

    order = ["cell", F.xxhash64("id"), "id"]
    parts = max(1, rows.count() // (4 * size))
    placed = rows.mapInArrow(place, "id long, v array<double>, cell int").repartitionByRange(parts, *order).sortWithinPartitions(*order).coalesce(parts)
    return stored(placed.mapInArrow(pack, BLOCKS), name)


def block_pairs(spark: SparkSession, queries: DataFrame, pool: DataFrame, centroids: np.ndarray) -> DataFrame:
    """q_block, r_block, best (the greatest cosine that a pair of their rows can have), by the blocks' heads alone."""
    apart = angles(centroids, centroids)
    table = [(i, j, float(apart[i, j])) for i in range(len(apart)) for j in range(len(apart))]
    between = F.broadcast(spark.createDataFrame(table, "q_cell int, r_cell int, apart double"))  # cells squared
    q = queries.select(F.col("block").alias("q_block"), F.col("cell").alias("q_cell"), F.col("radius").alias("q_radius"))
    r = pool.select(F.col("block").alias("r_block"), F.col("cell").alias("r_cell"), F.col("radius").alias("r_radius"))
    near = F.greatest(F.lit(0.0), F.col("apart") - F.col("q_radius") - F.col("r_radius"))
    return q.join(between, "q_cell").join(r, "r_cell").select("q_block", "r_block", (F.cos(F.least(near, F.lit(float(np.pi)))) + 1e-9).alias("best"))


def meet(pairs: DataFrame, queries: DataFrame, pool: DataFrame, k: int, dims: int) -> DataFrame:
    """query_id, vec_id, similarity: the k best rows of each pair of blocks for each of its queries."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, q, ids, x = (batch.column(c)[i].values for c in range(4))
                names, q, ids, x = names.to_numpy(), q.to_numpy().reshape(-1, dims), ids.to_numpy(), x.to_numpy().reshape(-1, dims)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                sim = q @ x.T / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None] + 1e-12)
                top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                yield pa.record_batch([pa.array(np.repeat(names, top.shape[1])), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(sim, top, axis=1).ravel())], names=["query_id", "vec_id", "similarity"])

    q = queries.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"))
    r = pool.select(F.col("block").alias("r_block"), F.col("ids").alias("r_ids"), F.col("v").alias("r_v"))
    return pairs.join(q, "q_block").join(r, "r_block").select("q_ids", "q_v", "r_ids", "r_v").mapInArrow(best, "query_id long, vec_id long, similarity double")


def cosine_neighbours(pool: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", cells: int = CELLS, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k nearest of the pool for each query, exactly; ties go to the smaller id.

    similarity is the inner product over the product of the lengths (plus 1e-12).  Queries have distinct ids and stay on
    the executors.  Rows without an id, a vector or with a component that is null or not finite take no part; all vectors
    have one length.  An empty side gives no rows.
    """
    spark = pool.sparkSession
    rows = usable(pool, id_col, vec_col)
    sample = matrix_of(rows.orderBy(F.xxhash64("id"), "id").limit(cells).select("v").toArrow())
    empty = spark.createDataFrame([], "query_id long, vec_id long, similarity double, rank int")
    if sample is None:
        return empty
    size = np.sqrt((sample * sample).sum(axis=1))[:, None]
    centroids = np.divide(sample, size, out=np.zeros_like(sample), where=size > 0)
    table = blocks(rows, centroids, block_rows, "knn-blocks")
    asked = blocks(usable(queries, id_col, vec_col), centroids, block_queries, "knn-query-blocks")
    dims = centroids.shape[1]
    ranked = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    if table.count() * asked.count() <= few_pairs:
        every = asked.select(F.col("block").alias("q_block")).join(F.broadcast(table.select(F.col("block").alias("r_block"))))  # at most few_pairs rows
        return meet(every, asked, table, k, dims).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    pairs = stored(block_pairs(spark, asked, table, centroids), "knn-pairs")
    first = Window.partitionBy("q_block").orderBy(F.desc("best"), F.xxhash64("q_block", "r_block"))
    near = stored(pairs.withColumn("__i", F.row_number().over(first)).filter("__i = 1").select("q_block", "r_block"), "knn-first")
    seen = stored(meet(near, asked, table, k, dims), "knn-seen")
    least = seen.withColumn("__i", F.row_number().over(ranked)).filter(F.col("__i") == k).select("query_id", F.col("similarity").alias("least"))
    need = asked.select(F.col("block").alias("q_block"), F.explode("ids").alias("query_id")).join(least, "query_id", "left").groupBy("q_block").agg(F.min(F.coalesce("least", F.lit(-2.0))).alias("need"))
    rest = stored(pairs.join(shared_if_small(need, 24), "q_block").filter("best >= need").select("q_block", "r_block").join(near, ["q_block", "r_block"], "left_anti"), "knn-rest")
    found = seen.unionByName(meet(rest, asked, table, k, dims))
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def matrix_of(table: pa.Table) -> np.ndarray | None:
    return matrix(table.column(0).combine_chunks(), len(table.column(0)[0])) if table.num_rows else None
