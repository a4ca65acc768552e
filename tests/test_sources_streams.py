"""Multi-source harvest, streams, and exact decimals."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import near_dup as N
from brindle.sources import harvest as H
from brindle.sources.scratch import new_path
from brindle.streaming import shield


def table(spark, name, n, chars=400):
    return spark.range(n).select(F.col("id"), F.concat(F.lit(f"{name} "), F.rpad(F.col("id").cast("string"), chars - len(name) - 1, "x")).alias("text"))


def taken(spark, sources, budget, **kw):
    rows, log = H.harvest_sources(spark, sources, token_budget=budget, **kw)
    return [(r.source, r.id) for r in rows.orderBy("src_ord", F.col("id").cast("long")).collect()], log


def test_harvest_stops_before_later_sources_and_skips_broken_ones(spark):
    def never():
        raise AssertionError("opened after the budget was spent")

    def broken():
        raise OSError("gated")

    sources = [H.Source("a", lambda: table(spark, "a", 10), ("id",)), H.Source("broken", broken, ("id",)), H.Source("held out", lambda: {"test": table(spark, "t", 9), "dev": table(spark, "t", 9)}, ("id",)), H.Source("b", lambda: table(spark, "b", 5000), ("id",)), H.Source("never", never, ("id",))]
    got, log = taken(spark, sources, 3000)  # 100 tokens a row: 10 rows of a, then 20 of b
    assert got == [("a", str(i)) for i in range(10)] + [("b", str(i)) for i in range(20)]
    assert [x.status for x in log] == ["taken", "skipped", "skipped", "taken", "unopened"] and log[1].reason == "gated"
    assert log[3].tokens == 2000 and log[3].rows_read <= 200  # of 5000: the text of the rest is never read
    assert taken(spark, sources[:4], 2950)[0] == got  # the last row may overshoot
    assert len(taken(spark, [sources[0], sources[3]], None)[0]) == 5010
    assert taken(spark, sources[:1], 0)[0] == []


def test_harvest_of_slices_nulls_and_files(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else f"{i} " + "y" * 200) for i in range(300)] + [(None, "z" * 100)], "id long, text string")
    got, log = taken(spark, [H.Source("n", lambda: rows, ("id",))], 2000, least_tokens=500)  # the first slice is too short: more follow
    assert got == [("n", None)] + [("n", str(i)) for i in range(0, 120, 3)] and log[0].status == "taken"
    path = new_path(spark, "harvest-files")
    table(spark, "f", 50).coalesce(1).write.parquet(path)
    files, _ = taken(spark, [H.Source("f", lambda: spark.read.parquet(path))], 1000)  # order of the files' rows
    assert files == [("f", str(i)) for i in range(10)]


def test_harvest_keeps_what_came_before_a_failure(spark):
    bad = table(spark, "c", 4000).withColumn("text", F.when(F.col("id") < 1000, F.col("text")).otherwise(F.raise_error(F.lit("broken file")).cast("string")))
    got, log = taken(spark, [H.Source("c", lambda: bad, ("id",)), H.Source("d", lambda: table(spark, "d", 3), ("id",))], 300_000, least_tokens=2000)
    assert log[0].status == "stopped" and log[1].status == "taken"
    assert [x for x in got if x[0] == "c"] == [("c", str(i)) for i in range(log[0].tokens // 100)] and 0 < log[0].tokens <= 100_000
    assert [x for x in got if x[0] == "d"] == [("d", str(i)) for i in range(3)]


def texts(n):
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(words[:50] + [f"own{i}"] * (i % 4 > 1) + [f"x{i % 5}y{j}" for j in range(0 if i % 7 else 40)])) for i in range(n)]


def test_stream_dedup_equals_the_batch_and_restarts(spark):
    rows = spark.createDataFrame([*texts(40), (40, None), (41, "")], "doc_id long, text string")
    want = {r.doc_id: r.kept for r in N.minhash_dedup(rows).collect()}
    assert len(set(want.values())) == 2
    source, out, state, check = (new_path(spark, x) for x in ("in", "out", "state", "check"))
    for lo in (0, 10):
        rows.filter(F.col("doc_id").between(lo, lo + 9)).coalesce(1).write.mode("append").parquet(source)
    shield.dedup_stream(shield.file_stream(spark, source, 1), out, state, check)
    first = {r.doc_id: r.kept for r in spark.read.parquet(out).collect()}
    for lo in (20, 30):
        rows.filter(F.col("doc_id").between(lo, lo + 11 if lo == 30 else lo + 9)).coalesce(1).write.mode("append").parquet(source)
    shield.dedup_stream(shield.file_stream(spark, source, 1), out, state, check)  # goes on from the checkpoint
    got = {r.doc_id: r.kept for r in spark.read.parquet(out).collect()}
    assert first == {k: v for k, v in want.items() if k < 20} and got == want
    settle = shield.settle_batch(state, out)
    settle(rows.filter(F.col("doc_id").between(20, 29)), 2)  # a micro-batch that runs again changes nothing
    assert {r.doc_id: r.kept for r in spark.read.parquet(out).collect()} == want


def test_stream_shield_equals_the_batch_and_restarts(spark):
    rows = spark.createDataFrame([*[(i, t, "own") for i, t in texts(30)], (30, None, "x"), (31, "", "y")], "doc_id long, text string, band string")
    index = N.lsh_index(rows.filter("doc_id IN (3, 14)"), 0.8)
    want = sorted(r.doc_id for r in N.leakage_filter(rows, index).collect())
    assert 2 < len(want) < 30
    assert sorted(r.doc_id for r in shield.shield_stream(rows, index).collect()) == want
    source, out, check = (new_path(spark, x) for x in ("in", "out", "check"))
    for lo in (0, 16):
        rows.filter(F.col("doc_id").between(lo, lo + 15)).write.mode("append").parquet(source)
        shield.run_once(shield.shield_stream(shield.file_stream(spark, source, 1), index), out, check)
    got = spark.read.parquet(out)
    assert sorted(r.doc_id for r in got.collect()) == want and got.columns == rows.columns


VALUES = [-16.28125, 0.5, 1.5, 2.5, 0.125, 0.375, -0.0, 0.0, 1e-9, -1e-9, 0.00005, 1.00005, 2.675, 1e15, 123456.78905, 0.99995, float("inf"), float("-inf"), float("nan"), 5e-324, 4503599627370495.5]


def test_decimals_match_printf(spark):
    rows = spark.createDataFrame([(v,) for v in VALUES], "x double")
    for digits in (0, 1, 3, 4):
        got = rows.select(X.fixed("x", digits).alias("a"), X.fixed("x", digits, plus=True).alias("b")).collect()
        assert [tuple(r) for r in got] == [(f"{v:.{digits}f}", f"{v:+.{digits}f}") for v in VALUES if True]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.integers(-(10**7), 10**7).map(lambda i: i / 32), st.integers(-(10**6), 10**6).map(lambda i: i / 20000)), min_size=200, max_size=400))
def test_decimals_match_printf_at_random(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "x double").select(X.fixed("x", 4, plus=True).alias("a")).collect()
    assert [r.a for r in got] == [f"{v:+.4f}" for v in values]


def test_difference_summary_with_a_tie(spark):
    from brindle.operators import reports as R

    rows = spark.createDataFrame([("MCQA", 42, -16.28125), ("MCQA", 43, 0.00003)], "adapter string, seed int, d double")
    assert R.seed_difference_summary(rows, []).first().per_seed == "s42=-16.2812; s43=+0.0000"


def test_times_and_tables_round_half_even(spark):
    from brindle.operators import reports as R

    assert [r.t for r in spark.createDataFrame([(0.25,), (0.35,), (75.0,), (3618.0,)], "s double").select(R.human_time("s").alias("t")).collect()] == ["0.2s", "0.3s", "1.2m", "1.00h"]
    stats = spark.createDataFrame([("m", 0, 0.0625, 0.5), ("m", 3, -0.1875, 0.0005)], "model string, n_shot int, dz double, p double")
    assert tuple(R.dz_table(stats, [0, 3]).first()) == ("m", "+0.062", "-0.188***")


if __name__ == "__main__":
    pytest.main([__file__])


def test_harvest_with_ties_at_the_budget(spark):
    from brindle.operators import corpus as C

    rows = spark.createDataFrame([(i // 10, "x" * 400, i) for i in range(50)] + [(None, "y" * 400, 99), (1, None, 98)], "k int, text string, id int").repartition(3)
    for budget, n in ((0, 0), (1, 1), (1000, 10), (1100, 11), (1101, 12), (1500, 15), (10**6, 51), (None, 51)):
        got = C.harvest(rows, [F.col("k")], token_budget=budget).collect()
        assert len(got) == n and (budget is None or n in (0, 51) or [r.k for r in sorted(got, key=lambda r: (r.k is not None, r.k or 0))] == sorted([None] + [i // 10 for i in range(n - 1)], key=lambda k: (k is not None, k or 0)))
