import tracemalloc

import numpy as np
import pyarrow as pa

from brindle.llm import language as L


def test_training_holds_one_matrix_and_no_lists_of_numbers():
    """pipeline: the driver fits the model, so its sample stays in Arrow's memory and is spread into one matrix."""
    draw = np.random.default_rng(7)
    rows = [np.sort(draw.choice(3 * L.BUCKETS, 600, replace=False)).astype(np.int32) for _ in range(400)]
    shares = [draw.random(600, np.float32) for _ in rows]
    table = pa.table({"at": pa.array(rows, pa.list_(pa.int32())), "share": pa.array(shares, pa.list_(pa.float32()))})
    langs = [("a", "b", "c")[i % 3] for i in range(400)]
    tracemalloc.start()
    got = L.train(L._views(table.slice(0, 400)), langs, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 400 * 3 * L.BUCKETS * 4
    want = L.train([(a.astype(np.int64), s) for a, s in zip(rows, shares)], langs, rounds=3)
    assert (got.weights == want.weights).all() and (got.bias == want.bias).all()
    assert [(a.tolist(), s.tolist()) for a, s in L._views(table.slice(5, 2))] == [(rows[i].tolist(), shares[i].tolist()) for i in (5, 6)]


def test_views_of_no_rows():
    assert L._views(pa.table({"at": pa.array([], pa.list_(pa.int32())), "share": pa.array([], pa.list_(pa.float32()))})) == []
