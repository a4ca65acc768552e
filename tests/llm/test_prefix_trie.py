"""The prefix trie against a plain version on small tables and odd rows."""

import hashlib
import random
import zlib

import pytest

from brindle.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, base string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", (text or "")[:64], T_digest(role, text), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v, key=lambda x: x[:4])] for c, v in convs.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + t[h:]
    members = {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        childless = [x for x in below if not any(y[:-1] == x for y in below if len(y) == len(x) + 1)]
        ends = sorted(c for c in m if len(rebuilt[c]) == len(node))
        out.append((
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(x) == len(node) + 1 for x in below), len(childless),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def T_digest(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16]


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    got = T.prefix_trie(df)
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect()), key=repr)


def test_families_copies_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "Été 𝄞", "long " * 40, ""]) + ("" if rng.random() < 0.7 else str(c))) for c in [*range(0, 40), *range(100, 130), *range(250, 290), 1000, 1001, 77_700] for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"copy {t}") for c in range(400, 460) for t in range(5)]  # one path in many members
    rows += [(c, t, "user", f"copy {t}") for c in range(500, 560) for t in range(5)]
    rows += [(900, None, None, None), (900, 3, "user", None), (901, None, "user", "b"), (901, None, "user", "a"), (901, 2, None, "x"), (901, 2, None, "x"), (None, 1, "user", "nobody"), (-5, 0, "user", "hi"), (-250, 0, "user", "hi"), (-205, 1, "user", "hi")]
    rows += [(2000, t, "user", f"deep {t}") for t in range(70)] + [(2100, t, "user", f"deep {t}") for t in range(70)]
    assert found(spark, rows) == plain(rows)


def test_one_conversation_and_no_rows(spark):
    assert found(spark, [(7, 0, "user", "x")]) == plain([(7, 0, "user", "x")])
    assert found(spark, []) == []


def test_subtree_sums_by_doubling(spark):
    path = [bytes([i]) for i in range(20)]
    rows = [(path[i], [path[i - d] for d in (1, 2, 4, 8, 16) if i >= d], i, 1) for i in range(20)]
    got = {r.key: (r.a, r.b) for r in T.subtree_sums(spark.createDataFrame(rows, "key binary, anc array<binary>, a long, b long"), ["a", "b"]).collect()}
    assert got == {path[i]: (sum(range(i, 20)), 20 - i) for i in range(20)}


def test_ends_are_hashed_in_order(spark):
    rows = [(b"k", 100 * i, f"{100 * i},{100 * i + 1}") for i in range(300)] + [(b"m", -100, "-150,-100"), (b"m", 0, "-3,0")]
    got = {bytes(r.key): r.ends_sha256 for r in T.ends_digests(spark.createDataFrame(rows, "key binary, base long, ends string").repartition(5)).collect()}
    want = ",".join(f"{100 * i},{100 * i + 1}" for i in range(300))
    assert got == {b"k": hashlib.sha256(want.encode()).hexdigest(), b"m": hashlib.sha256(b"-150,-100,-3,0").hexdigest()}


@pytest.mark.parametrize("name", ["prefix_trie"])
def test_extra_columns_are_not_read(spark, name):
    df = spark.createDataFrame([(1, 0, "user", "x", 9, 9, 9)], "conv_id int, turn int, role string, text string, n_convs int, key int, ends int")
    assert getattr(T, name)(df).count() in (1, 2)
