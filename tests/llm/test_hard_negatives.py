"""Hard negatives against a plain version: random, clustered, tied, repeated, hot, odd and very large vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, block int"


def plain(rows, k=5, m=3):
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q, lab) in enumerate(ok):
        if i % 5:
            continue
        scored = [(-max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(q, v)))), j, other == lab) for b, (j, v, other) in enumerate(ok) if b != a]
        scored.sort()
        for s, j, _ in [x for x in scored if x[2]][:k]:
            fits = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:m]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits)]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("id") % 5 == 0, **kw).collect())


def vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    return [(centres[i % 7] + spread * rng.normal(size=dims)).round(3).tolist() for i in range(n)]


@pytest.mark.parametrize("spread,block", [(0.02, 16), (1.0, 16), (0.3, 2048)])
def test_random_and_clustered(spark, spread, block):
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(1, 150, 6, spread))]
    assert found(spark, rows, block_rows=block, block_anchors=8) == plain(rows)


def test_ties_repeats_hot_and_odd_rows(spark):
    v = vectors(2, 60, 4, 0.5)
    rows = [(i, x, i % 2) for i, x in enumerate(v)] + [(i, v[0], 5) for i in range(100, 140)] + [(200 + i, v[1], 0) for i in range(30)] + [(5, v[5], 1), (5, v[5], 1), (5, v[6], 0)]
    rows += [(300, None, 1), (305, v[3], None), (None, v[3], 1), (310, [1.0, None, 0.0, 0.0], 1), (315, [float("nan")] * 4, 1), (320, [float("inf"), 0.0, 0.0, 0.0], 0), (325, [], 1), (330, [1.0, 2.0], 1), (335, [0.0] * 4, 0), (340, [-1.0] * 4, 9), (-10, v[7], 0), (-5, v[8], 1)]
    assert found(spark, rows, block_rows=8, block_anchors=4) == plain(rows)


def test_large_components(spark):
    rows = [(i, [x * 10.0 ** (3 * (i % 4)) for x in v], i % 2) for i, v in enumerate(vectors(3, 40, 3, 0.3))] + [(50, [1e300, -1e300, 1.0], 0), (51, [1e300, 1e10, 1.0], 1), (55, [1e-300, 0.0, 0.0], 0)]
    assert found(spark, rows, block_rows=8) == plain(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1)]) == []
    assert found(spark, [(5, [1.0], 1)]) == []


def test_brackets_hold_and_rule_out():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([rng.normal(size=(50, 5)) * 0.05 + c for c in rng.normal(size=(4, 5))]))
    q = x[::10] + 1
    largest = float((x * x).sum(axis=1).max())
    pivots = H.augmented(x[::40], largest)
    low, high = H.bounds((q * q).sum(axis=1), H.distances(np.column_stack([q, np.zeros(len(q))]), pivots), H.distances(H.augmented(x, largest), pivots), largest)
    score = q @ x.T
    assert (low <= score).all() and (score <= high).all()
    fifth = np.sort(score, axis=1)[:, -5]
    assert (high < fifth[:, None]).mean() > 0.3  # rows ruled out without their components
