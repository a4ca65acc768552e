"""Nearest neighbours against brute force, and the blocks that bounds leave."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import knn as K


def brute(rows, queries, k):
    out = []
    for q, a in queries:
        a = np.array(a)
        sims = sorted((-(a @ np.array(b)) / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-12), i) for i, b in rows)
        out += [(q, i, n + 1, round(-s, 9)) for n, (s, i) in enumerate(sims[:k])]
    return sorted(out)


def found(spark, rows, queries, k, **kw):
    make = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>, id string, v int").repartition(3)
    got = K.cosine_neighbours(make([(*r, "x", 1) for r in rows]), make([(*r, "x", 1) for r in queries]), k, **kw)
    return sorted((r.query_id, r.vec_id, r.rank, round(r.similarity, 9)) for r in got.collect())


def clustered(seed, n, spread, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(i, (centres[i % 12] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread,k,few", [(0.05, 5, 0), (1.0, 5, 0), (0.3, 1, 0), (0.3, 50, 0), (0.3, 5, 10**6)])
def test_equal_to_brute_force(spark, spread, k, few):
    rows = clustered(1, 240, spread)
    queries = [*rows[::20], (-5, [1.0] * 8)]
    assert found(spark, rows, queries, k, cells=10, block_rows=16, block_queries=8, few_pairs=few) == brute(rows, queries, k)


def test_copies_zeros_and_odd_rows(spark):
    rows = [*clustered(2, 60, 0.4), *[(100 + i, clustered(2, 1, 0.4)[0][1]) for i in range(50)], (200, [0.0] * 8), (201, [0.0] * 8)]
    odd = [(None, [1.0] * 8), (300, None), (301, [float("nan")] + [0.0] * 7), (302, [None] + [0.0] * 7), (303, [float("inf")] * 8)]
    queries = [rows[0], rows[7], (200, [0.0] * 8)]
    assert found(spark, rows + odd, queries + odd[1:], 8, cells=6, block_rows=8, block_queries=2, few_pairs=0) == brute(rows, queries, 8)
    assert found(spark, [], queries, 3) == [] and found(spark, rows, [], 3) == []


def test_bounds_rule_blocks_out(spark):
    rows = clustered(3, 600, 0.02)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    sample = K.matrix_of(df.orderBy(F.xxhash64("id")).limit(40).select("v").toArrow())
    centroids = sample / np.linalg.norm(sample, axis=1)[:, None]
    pool, asked = K.blocks(df, centroids, 16, "t-rows"), K.blocks(df.filter("id % 30 = 0"), centroids, 8, "t-queries")
    assert pool.agg(F.sum("n")).first()[0] == 600 and pool.agg(F.max("n")).first()[0] <= 16
    pairs = K.block_pairs(spark, asked, pool, centroids)
    every, near = pairs.count(), pairs.filter("best > 0.99").count()
    assert every == pool.count() * asked.count() and near < every / 4
    vectors = {r.id: np.array(r.v) / np.linalg.norm(r.v) for r in df.collect()}
    held = lambda t: {r.block: r.ids for r in t.collect()}
    q, p = held(asked), held(pool)
    for r in pairs.collect():
        assert max(float(vectors[a] @ vectors[b]) for a in q[r.q_block] for b in p[r.r_block]) <= r.best + 1e-9
