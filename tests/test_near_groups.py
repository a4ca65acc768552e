"""Greedy near-duplicate removal of large near groups: equal to the loop, without squares of pairs."""

import random

import pytest

from brindle.operators import near_dup as N


def loop(rows, threshold):
    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    kept, out = [], {}
    for i, t in sorted(rows):
        s = shingles(t)
        out[i] = not s or all(len(s & k) < threshold * len(s | k) - 1e-12 for k in kept)
        if out[i] and s:
            kept.append(s)
    return out


def group(seed, n, words, changes):
    rng = random.Random(seed)
    base = [f"g{seed}w{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(words)] = f"x{seed}y{i}z{rng.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_equal_to_the_loop(spark, monkeypatch, rounds):
    monkeypatch.setattr(N, "LEADER_ROUNDS", rounds)
    rng = random.Random(rounds)
    texts = [t for g in range(6) for t in group(g, 9, 60, g % 4)] + group(50, 12, 80, 2)
    texts += [" ".join(texts[k].split()[: 60 - 4 * j] + [f"t{k}u{i}" for i in range(3 * j)]) for k in range(0, 50, 7) for j in range(3)] + ["", None, "one two", "one two", "a b c d e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.kept for r in N.near_dup_greedy(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == loop(rows, 0.85)


def test_near_group_makes_no_squares(spark):
    compared = {}
    for n in (50, 100, 200):
        rows = list(enumerate(group(7, n, 300, 1)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        sets, heads = N.prefix_heads(N.shingle_classes(df)[1], 0.85)
        live, dropped, pairs = N.greedy_leaders(heads, sets, 0.85)
        assert live.isEmpty() and dropped.distinct().count() == n - 1
        compared[n] = pairs
    assert compared == {50: 49, 100: 99, 200: 199}


def test_only_classes_that_can_meet_go_on(spark):
    common = " ".join(f"c{i}" for i in range(12))  # a passage that all hold makes no partners
    texts = [" ".join([*(f"a{g}b{i}" for i in range(100)), common]) for g in range(30)]
    texts += [t + " end" for t in texts[:4]] + texts[:2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, sets = N._members(df, 5, "doc_id", "text")
    assert {r.id for r in N.meeting_classes(members, sets, 0.85).collect()} == {0, 1, 2, 3, 30, 31, 32, 33}
    assert {(r.a, r.b) for r in N.jaccard_pairs(df)[1].collect()} == {(i, 30 + i) for i in range(4)}
