"""Functions and operators against plain Python versions, published values and properties."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import dist
from brindle.functions import metrics as M
from brindle.functions import text as X
from brindle.operators import corpus as C
from brindle.operators import judging as J
from brindle.operators import near_dup as N
from brindle.operators import stats as S
from brindle.sources import files


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_text_values(spark):
    got = one(
        spark, em=M.exact_match(F.lit("Le patient"), F.lit("patient")), f1=M.token_f1(F.lit("le patient présente une dyspnée"), F.lit("le patient a une dyspnée")),
        letters=X.letters(F.lit("La bonne réponse est A et C")), trap=X.letters(F.lit("Le patient a besoin d'une radio, réponse B")), strict=X.letters_strict(F.lit("Le patient a besoin d'une radio, réponse B")),
        hamming=M.hamming(F.array(F.lit("A"), F.lit("C")), F.array(F.lit("A"), F.lit("B")), 5), article=X.normalize_answer(F.lit("l'hôpital")), empty=M.set_accuracy(F.lit(""), F.lit("")),
        clean=X.clean_text(F.lit(" a\x01 b\n\n\n\nc ")), none=X.clean_text(F.lit(None).cast("string")), span=X.trim_to_span(F.lit("<think>x</think>\n «Bonjour le monde»\ny")),
    )
    assert got.em == 1 and 0.5 < got.f1 < 1 and got.letters == ["A", "C"] and got.trap == ["A", "B", "D"] and got.strict == ["B"]
    assert got.hamming == pytest.approx(0.6) and got.article == "l hôpital" and got.empty == 1 and got.clean == "a b\n\nc" and got.none == "" and got.span == "Bonjour le monde"


def test_rubric_and_verdicts(spark):
    texts = ['```json\n{"factual": 4, "completeness": 3, "relevance": 5, "safe": 5}```', "{'factual': 4, 'complete': 3, 'relevance': 5, 'safety': 2}", "factual: 3 complete: 2 relevance=4 safety: 5", "4 5 3 2", '{"factual": 7, "complete": 3, "relevance": 5, "safety": 5}', ""]
    got = [r.p and r.p.composite for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.parse_rubric("t").alias("p")).collect()]
    assert got == [4.25, 3.5, 3.5, 3.5, None, None]
    rows = spark.createDataFrame([("A", "A"), ("A", "B"), (None, "B"), (None, None), ("TIE", "TIE")], "a string, b string").select(X.combine_passes("a", "b").alias("c")).collect()
    assert [tuple(r.c) for r in rows] == [("tie", False), ("challenger", True), ("challenger", False), (None, False), ("tie", True)]


def test_messages(spark):
    options = F.create_map(*[F.lit(x) for kv in zip("ABCDE", ["Embolie", "b", "c", "d", "e"]) for x in kv])
    demo = F.array(F.struct(X.mcqa_prompt(F.lit("q0"), options).alias("prompt"), F.lit("A").alias("answer")))
    chat = one(spark, m=X.build_messages(X.mcqa_prompt(F.lit("q"), options), demo)).m
    assert [m.role for m in chat] == ["system", "user", "assistant", "user"] and "A) Embolie" in chat[-1].content and chat[-1].content.endswith("Réponse:")


def test_text_metrics():
    assert M.rouge_l_score("the cat sat", "the cat sat") == 1 and M.rouge_l_score("", "x") == 0
    assert M.rouge_l_score("a b c d", "a x c d") == pytest.approx(0.75)
    assert M.bleu4_score("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(1)
    assert M.bleu4_score("x", "y") == 0


def test_distributions():
    assert dist.t_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5) and dist.t_quantile(0.975, 30) == pytest.approx(2.042272, abs=1e-5)
    assert dist.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and dist.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert dist.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert dist.mcnemar(3, 3) == pytest.approx(1.3125) and dist.mcnemar(0, 0) == 1 and dist.sign_test(9, 1) == pytest.approx(0.021484375)
    assert dist.wilcoxon(np.array([1, 2, 3, 4, 5.0])) == pytest.approx(0.0625) and dist.wilcoxon(np.zeros(4)) == 1


def test_bh(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.5, None, math.nan])], "k int, p double")
    got = [r.q for r in S.benjamini_hochberg(df, "p", [], ["k"]).orderBy("k").collect()]
    assert got == [pytest.approx(0.04)] * 3 + [pytest.approx(0.5), None, None]


def test_greedy_chain(spark):
    ids = spark.createDataFrame([(i,) for i in range(3)], "doc_id long")
    kept = N.greedy_keep(ids, spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"))
    assert {r.doc_id: r.kept for r in kept.collect()} == {0: True, 1: False, 2: True}


def test_greedy_equals_loop(spark):
    rng = random.Random(7)
    for _ in range(4):
        n = 30
        buckets = {(rng.randrange(n), rng.randrange(15)) for _ in range(45)}
        pairs = sorted({(a, b) for a, x in buckets for b, y in buckets if x == y and a < b})
        kept: list[int] = []
        for d in range(n):
            if not any((k, d) in pairs for k in kept):
                kept.append(d)
        ids = spark.createDataFrame([(i,) for i in range(n)], "doc_id long")
        edges = spark.createDataFrame(pairs, "a long, b long")
        assert sorted(r.doc_id for r in N.greedy_keep(ids, edges).filter("kept").collect()) == kept
        members = spark.createDataFrame([(a, str(x)) for a, x in buckets], "id long, bucket string")
        assert sorted(r.id for r in N.greedy_buckets(members).collect()) == [k for k in kept if any(k == a for a, _ in buckets)]


@pytest.mark.parametrize("n,r,expected", [(10, 3, "dddrdddrdddrd"), (2, 5, "drdrrrr")])
def test_interleave(spark, n, r, expected):
    domain = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").alias("pos"))
    replay = spark.range(100, 100 + r).select(F.col("id").alias("doc_id"))
    out = C.interleave_replay(domain, replay, ratio=r / (n + r)).orderBy("pos").collect()
    assert [x.pos for x in out] == list(range(n + r)) and "".join(x.kind[0] for x in out) == expected


def test_curriculum_sizes(spark):
    scored = spark.range(10).select(F.col("id").alias("doc_id"), F.col("id").cast("double").alias("ppl"))
    sizes = [r["count"] for r in C.curriculum(scored, buckets=6).groupBy("bucket").count().orderBy("bucket").collect()]
    assert sizes == [2, 2, 2, 2, 1, 1]
    with pytest.raises(ValueError):
        C.curriculum(scored, scheme="other")


def test_harvest_overshoots(spark):
    docs = spark.createDataFrame([(0, "x" * 40), (1, "y" * 40), (2, None), (3, "z" * 40)], "doc_id long, text string")
    got = C.harvest(docs, [F.col("doc_id")], token_budget=15).collect()
    assert sorted(r.doc_id for r in got) == [0, 1]


def test_splits():
    assert C.training_splits(["train", "test"]) == ["train"] and C.training_splits(["part", "dev_x"]) == ["part"] and C.training_splits(["eval"]) == []


def test_shield(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, "a", text), (2, "b", text), (3, "a", "other words here"), (4, "a", None)], "id long, task string, q string")
    tests = spark.createDataFrame([("a", text)], "task string, q string")
    out = N.shield_flags(rows, tests, F.col("q"), F.col("q"), id_col="id", by="task")
    assert {r.id: r.leaked for r in out.collect()} == {1: True, 2: False, 3: False, 4: False}


def test_sources(spark, tmp_path):
    import json
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("train.json", json.dumps([{"id": "1"}, {"id": "2"}]))
    assert sorted(r.id for r in files.read_zip_json(spark, str(tmp_path / "a.zip"), "id string").collect()) == ["1", "2"]

    def fails():
        raise OSError("gone")

    assert files.first_readable([fails, lambda: spark.range(0), lambda: spark.range(2)]).count() == 2
    files.write_small_json({"a": 1}, str(tmp_path / "x.json"))
    assert json.load(open(tmp_path / "x.json")) == {"a": 1}


def test_numeric_leaves(spark):
    df = spark.createDataFrame([(1, (2.5, True), "x")], "k int, s struct<v: double, b: boolean>, t string")
    assert [tuple(r) for r in J.unpivot_numbers(df, ["k"]).collect()] == [(1, "s.v", 2.5)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-5, 5, allow_nan=False), min_size=1, max_size=20))
def test_wilcoxon_is_a_probability(d):
    assert 0 <= dist.wilcoxon(np.array(d)) <= 1
