"""Suffix-array dedup against a plain version: shared passages, periodic, long, hot and odd texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, o string, tk string, pos int, h int"


def plain(rows, order=lambda t: 0):
    """doc_id, bytes, spans, kept of distinct (doc_id, text) rows in order of id (null last), then of `order`."""
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, order(r[1]))):
        b = t.encode()
        off = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                off[p : p + 100] = True
            seen.add(b[p : p + 100])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]])))
        out[i, t] = (len(b), list(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(c for c, x in zip(b, off) if not x))
    return sorted(((i, *out[i, t or ""]) for i, t in rows), key=repr)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted(((r.doc_id, r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept)) for r in S.dedup_suffixes(df, **kw).collect()), key=repr)


def prose(rng, n):
    return "".join(rng.choice("abc é\n") for _ in range(n))


def passages(seed):
    rng = random.Random(seed)
    base = prose(rng, 1500)
    rows = []
    for i in range(60):
        a = rng.randrange(1200)
        part = base[a : a + rng.choice([60, 97, 98, 99, 100, 101, 150, 290])]
        rows.append((i, prose(rng, rng.randrange(120)) + part + prose(rng, rng.randrange(90)) + (part if i % 7 == 0 else "")))
    return rows


def test_shared_passages_copies_and_odd_rows(spark):
    rows = passages(1)
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(200, None), (201, ""), (202, "x" * 99), (203, "x" * 100), (204, "x" * 101), (205, "ab" * 400), (206, "ba" * 300), (207, "short"), (208, "short"), (210, rows[8][1] + "!"), (210, rows[8][1] + "!")]
    rows += [(-5, rows[9][1]), (None, rows[10][1] + rows[11][1]), (220, "𝄞é" * 60), (221, "𝄞é" * 59 + "é𝄞" * 30)]
    assert found(spark, rows) == plain(rows)


def test_large_buckets_are_cut_again(spark):
    rng = random.Random(2)
    phrase = prose(rng, 70)
    rows = [(i, prose(rng, 95) + phrase + prose(rng, 95)) for i in range(80)] + [(100 + i, "tail " + phrase + "same end " * 9 + str(i % 3)) for i in range(30)] + [(200 + i, "z" * (100 + i % 4)) for i in range(20)]
    assert found(spark, rows, most=4) == plain(rows)
    assert found(spark, rows, most=1) == plain(rows)


def test_null_ids_and_equal_ids_have_an_order(spark):
    rng = random.Random(4)
    shared = prose(rng, 200)
    rows = [(None, shared + "n"), (7, shared + "a"), (7, shared + "b"), (9, shared)]
    key = {r[0]: r[1] for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    assert found(spark, rows) == plain(rows, key.get)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_long_texts_are_cut_in_parts():
    rng = random.Random(6)
    text = prose(rng, 5000)
    whole = set()
    for raw, offs, rows, base in S.pieces(pa.array(["", None, text, "tiny", text[:300]]), 700):
        assert len(raw) <= 700
        for i in range(len(rows)):
            part = raw[offs[i] : offs[i + 1]]
            whole |= {(int(rows[i]), int(base[i]) + p) for p in range(len(part) - 99)}
    n = len(text.encode())
    assert whole == {(2, p) for p in range(n - 99)} | {(4, p) for p in range(len(text[:300].encode()) - 99)}


@pytest.mark.parametrize("level", [0, 1, 3])
def test_stretches_hold_every_window_once(level):
    rng = random.Random(level)
    texts = [prose(rng, n) for n in (0, 80, 99, 400, 130, 1000)] + ["a" * 400]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    h, first, last, spot = S.stretches(raw, offs, level)
    got = [w for a, b in zip(first, last) for w in range(a, b + 1)]
    assert got == [w for a, b in zip(offs[:-1], offs[1:]) for w in range(a, b - 99)]
    assert ((spot >= last) & (spot <= first + 80)).all()
    by = {}
    for a, b, x in zip(first.tolist(), last.tolist(), h.tolist()):
        for w in range(a, b + 1):
            assert by.setdefault(raw[w : w + 100].tobytes(), x) == x  # equal windows, equal buckets


def test_difference_cover():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))
