"""Scorers, token gates, positional joins, resampling, versioned output, wide CSV and table functions against plain versions."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import dist, vocab
from brindle.functions import generators as G
from brindle.operators import corpus as C
from brindle.operators import qa as Q
from brindle.operators import resampling as RS
from brindle.operators import scoring
from brindle.operators import stats as S
from brindle.sources import files, partitioned
from brindle.sources.scratch import new_path


# scorers


def test_any_scorer_gets_cut_and_padded_batches(spark):
    class Lengths:
        """A scorer whose loss is a row's length, to see what reaches it; it fails on batches that are too large or too long."""

        def load(self):
            return self

        def tokens(self, text):
            return [ord(c) for c in text]

        def mean_nll(self, ids, lengths):
            assert ids.shape[0] <= 8 and ids.shape[1] <= 10 and ids.shape[1] - lengths.min() <= 9
            assert all((row[n:] == 7).all() for row, n in zip(ids, lengths))
            return np.where(lengths > 1, lengths / 10.0, 0.0)

    rows = spark.createDataFrame([(i, "x" * (i % 25) if i % 9 else None) for i in range(60)], "doc_id int, text string").repartition(2)
    got = {r.doc_id: r.ppl for r in scoring.perplexities(rows, Lengths(), max_len=10, pad=7).collect()}
    want = {i: math.exp(min(10, i % 25) / 10) if i % 9 and i % 25 > 1 else 1.0 for i in range(60)}
    assert got == pytest.approx(want)


def test_bigram_scorer_matches_plain_python(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("Aa bb cc été dd".split()) for _ in range(rng.randrange(0, 40))) for _ in range(30)] + [None, "", "one", " \n"]
    ids = [[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in (t or "").lower().split()] for t in texts]
    size = 64
    one, two = np.zeros(size), np.zeros(size)
    for x in ids:
        for v in x:
            one[v % size] += 1
        for v, w in zip(x, x[1:]):
            two[(v * 1000003 + w) % size] += 1
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: r.ppl for r in scoring.perplexities(rows, scoring.fit_bigrams(rows, features=size, weight=0.6), max_len=12).collect()}
    for i, x in enumerate(ids):
        x = x[:12]
        nll = [-math.log(0.6 * two[(v * 1000003 + w) % size] / max(1, one[v % size]) + 0.4 * (one[w % size] + 1) / (one.sum() + size)) for v, w in zip(x, x[1:])]
        assert got[i] == pytest.approx(math.exp(min(20, sum(nll) / max(1, len(nll)))))


def test_only_the_sample_is_scored(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("text", F.col("doc_id").cast("string"))

    def score(docs):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return docs.select("doc_id").mapInArrow(count, "doc_id long").withColumn("ppl", F.col("doc_id").cast("double"))

    out = C.score_sample_impute(rows, score, 30).collect()
    assert len(out) == 200 and seen.value == 30
    assert len({r.ppl for r in out}) in (30, 31)


def test_vocabulary_of_another_corpus(spark):
    corpus = spark.createDataFrame([(1, "a a b"), (2, "b c")], "doc_id int, text string")
    got = C.unigram_perplexity(corpus.filter("doc_id = 2"), corpus).first().ppl
    assert got == pytest.approx(math.exp(-(math.log(3 / 8) + math.log(2 / 8)) / 2))


# tokenizers


def test_token_counts_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["Hello, world!", "", None, "été 𝄞 " * 300, "a\n\n\tb  c", "x" * 5000] + [f"n {i} " * i for i in range(150)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tok = tokenizers.Tokenizer.from_file(P.path(name))
        tok.no_truncation()
        want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
        got = {r.i: r.n for r in rows.select("i", vocab.token_count("text", P.path(name)).alias("n")).collect()}
        assert [got[i] for i in range(len(texts))] == want
        kept = {r.i: r.n_tokens for r in vocab.token_gate(rows, P.path(name), 24, 300).collect()}
        assert kept == {i: n for i, n in enumerate(want) if 24 <= n <= 300}


def test_rendered_chats_above_the_limit_go(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([("absqa", "why?", "c " * n, None, "so") for n in (0, 5, 400)] + [("absqa", None, "c", None, "so"), ("mcqa", "q", None, {"A": "x", "B": "y"}, "A")], "task string, question string, context string, options map<string,string>, answer string")
    every = vocab.train_pack(rows, path, 10**6).collect()
    assert len(every) == 4 and all("assistant" in r.text for r in every)
    limit = sorted(r.n_tokens for r in every)[2]
    assert sorted(r.n_tokens for r in vocab.train_pack(rows, path, limit).collect()) == sorted(r.n_tokens for r in every)[:3]


# positions


def test_positions_with_unequal_lengths(spark):
    left = spark.createDataFrame([("a", i, f"l{i}") for i in range(7)] + [("b", 1, "lb"), ("only left", 1, "x")], "g string, o int, v string").repartition(3)
    right = spark.createDataFrame([("a", 10 - i, f"r{i}") for i in range(4)] + [("b", 1, None), ("b", 2, "rb2"), ("only right", 1, "y")], "g string, p int, w string").repartition(2)
    got = sorted((r.g, r.pos, r.l.v, r.r.w) for r in S.positional_join(left, right, ["o"], ["p"], ["g"]).collect())
    assert got == [("a", 0, "l0", "r3"), ("a", 1, "l1", "r2"), ("a", 2, "l2", "r1"), ("a", 3, "l3", "r0"), ("b", 0, "lb", None)]
    assert S.positional_join(left, right.limit(0), ["g", "o"], ["p"]).count() == 0
    assert S.positional_join(left, right, ["g", "o"], ["g", "p"]).count() == 7


def test_positions_of_files(spark):
    a, b = new_path(spark, "pos-a"), new_path(spark, "pos-b")
    spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "x int").coalesce(1).write.parquet(a)
    spark.createDataFrame([(x,) for x in "pqr"], "y string").coalesce(1).write.parquet(b)
    got = S.positional_join(spark.read.parquet(a), spark.read.parquet(b), [], []).orderBy("pos").collect()
    assert [(r.pos, r.l.x, r.r.y) for r in got] == [(0, 5, "p"), (1, 3, "q"), (2, 9, "r")]


def test_arrays_by_position(spark):
    rows = spark.createDataFrame([([1, 2, 3], ["a"]), ([1], ["a", None]), (None, ["a"]), ([], []), ([None, 2], [None, "b"])], "a array<int>, b array<string>")
    got = [[tuple(x) for x in r.z] for r in rows.select(S.zip_arrays("a", "b").alias("z")).collect()]
    assert got == [[(0, 1, "a")], [(0, 1, "a")], [], [], [(0, None, None), (1, 2, "b")]]


# resampling


def test_poisson_thresholds():
    p = [math.exp(-1) / math.factorial(k) for k in range(12)]
    cuts = [0, *RS.POISSON]
    assert [(b - a) / 2**32 for a, b in zip(cuts, cuts[1:])] == pytest.approx(p, abs=1e-9)


def test_bootstrap_matches_plain_draws_and_the_normal_interval(spark):
    rng = random.Random(2)
    rows = [("m", i, rng.gauss(0.3, 1)) for i in range(300)] + [("few", 1, 0.5), ("few", 2, 1.0), ("none", 1, None)]
    pairs = spark.createDataFrame(rows, "model string, item int, d double").repartition(5)
    got = {r.model: r for r in RS.poisson_bootstrap(pairs, ["model"], ["item"], draws=402, seed=7).collect()}
    assert set(got) == {"m", "few"} and got["few"].ci_lo is None and got["few"].p_boot is None and got["few"].n == 2
    means = []
    for r in range(402):
        w = []
        for _, i, _ in rows[:300]:
            h = hashlib.md5(f"7|{r // 4}|m|{i}".encode()).hexdigest()
            u = int(h[8 * (r % 4) : 8 * (r % 4) + 8], 16)
            w.append(sum(u >= t for t in RS.POISSON))
        means.append(sum(k * d for k, (_, _, d) in zip(w, rows)) / sum(w))
    lo, hi = np.percentile(means, [2.5, 97.5])
    assert (got["m"].ci_lo, got["m"].ci_hi) == pytest.approx((lo, hi))
    assert got["m"].p_boot == pytest.approx(min(1, 2 * min(np.mean(np.array(means) <= 0), np.mean(np.array(means) >= 0))))
    d = np.array([x[2] for x in rows[:300]])
    half = 1.96 * d.std(ddof=1) / math.sqrt(300)
    assert abs(lo - (d.mean() - half)) < 0.04 and abs(hi - (d.mean() + half)) < 0.04


def test_signed_ranks_match_one_place(spark):
    rng = random.Random(3)
    cells = {"exact": [rng.gauss(0.4, 1) for _ in range(12)], "ties": [rng.randrange(-3, 5) / 2 for _ in range(40)], "large": [rng.gauss(0.1, 1) for _ in range(300)], "zeros": [0.0] * 6, "one": [1.0], "mixed": [0.0, 1.0, -1.0, 2.0]}
    rows = [(c, float(d)) for c, x in cells.items() for d in x]
    got = {r.c: r for r in RS.with_wilcoxon(RS.signed_ranks(spark.createDataFrame(rows, "c string, d double").repartition(7), ["c"])).collect()}
    for c, x in cells.items():
        own = np.array([d for d in x if d])
        ranks = np.array([(np.abs(own) < abs(d)).sum() + ((np.abs(own) == abs(d)).sum() + 1) / 2 for d in own])
        assert (got[c].n_pairs, got[c].n) == (len(x), len(own))
        assert got[c].w_plus == pytest.approx(ranks[own > 0].sum() if len(own) else 0)
        assert got[c].p_wilcoxon == pytest.approx(dist.wilcoxon(np.array(x)))
    # published table: n = 8, smaller rank sum 3: two-sided p = 10 / 256
    assert dist.signed_rank(8, 8, 3, 0) == pytest.approx(10 / 256)
    assert dist.rank_sum_ways(10).sum() == 1024


# versioned output


def test_one_partition_is_replaced_and_one_scanned(spark):
    schema = "task string, x int"
    path = partitioned.write_partitions(spark.createDataFrame([("mcqa", 1), ("extqa", 2), ("absqa", 3)], schema), "task")
    local = path.removeprefix("file://")
    before = {t: sorted(os.listdir(f"{local}/task={t}")) for t in ("mcqa", "extqa", "absqa")}
    partitioned.write_partitions(spark.createDataFrame([("mcqa", 10), ("mcqa", 11)], schema), "task", path)
    after = {t: sorted(os.listdir(f"{local}/task={t}")) for t in before}
    assert after["extqa"] == before["extqa"] and after["absqa"] == before["absqa"] and after["mcqa"] != before["mcqa"]
    assert sorted((r.task, r.x) for r in partitioned.read_partition(spark, path, schema, "task").collect()) == [("absqa", 3), ("extqa", 2), ("mcqa", 10), ("mcqa", 11)]
    one = partitioned.read_partition(spark, path, schema, "task", "extqa")
    assert [r.x for r in one.collect()] == [2]
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "extqa" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert {"task=extqa" in r.f for r in one.select(F.input_file_name().alias("f")).collect()} == {True}
    with pytest.raises(Exception):  # a job that fails replaces nothing
        partitioned.write_partitions(spark.createDataFrame([("extqa", 1)], schema).withColumn("x", F.raise_error(F.lit("no")).cast("int")), "task", path)
    assert sorted(os.listdir(f"{local}/task=extqa")) == before["extqa"]


def test_purge_once(spark):
    from brindle.operators import reports as R

    folder = new_path(spark, "purge")
    spark.range(3).coalesce(1).write.parquet(folder)
    assert R.purge_once(spark, folder, "part-*", "done") == 1
    spark.range(3).coalesce(1).write.mode("append").parquet(folder)
    assert R.purge_once(spark, folder, "part-*", "done") == 0  # the marker is there


# wide CSV


def test_two_header_rows(spark):
    rows = [("m,1", "f1", "0", 0.5), ("m,1", "f1", "5", 1.5), ('q"x', "f1", "0", -2.0), ("m,1", "em", "0", 1e-9)]
    long = spark.createDataFrame(rows, "model string, metric string, shots string, value double")
    path = files.write_wide_csv(long.repartition(3), index="model", levels=("metric", "shots"), value="value", columns=[("f1", "0"), ("f1", "5"), ("em", "0")])
    got = files.read_wide_csv(spark, path, levels=("metric", "shots"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows) and got.columns == ["model", "metric", "shots", "value"]


def test_header_as_other_programs_write_it(spark):
    folder = new_path(spark, "wide-text")
    spark.createDataFrame([("metric,f1,,em\nshots,0,5,0\nmodel,,,\na,1,2,3\nb,,x,6",)], "t string").coalesce(1).write.text(folder)
    got = sorted(tuple(r) for r in files.read_wide_csv(spark, folder, levels=("metric", "shots")).collect())
    assert got == [("a", "em", "0", 3.0), ("a", "f1", "0", 1.0), ("a", "f1", "5", 2.0), ("b", "em", "0", 6.0)]


# table functions


def test_converter_as_a_table_function(spark):
    rows = [(1, ["Un", "mal", "de", "tête"], ["O", "B-DISO", "I-DISO", "I-DISO"]), (2, None, None), (3, ["a"], ["B-X", "O"]), (4, ["a", "b"], ["B-X", "B-Y"]), (5, [], [])]
    s = spark.createDataFrame(rows, "sent_id int, tokens array<string>, tags array<string>")
    G.register(spark, "bio_spans_test", G.bio_spans, G.BIO_SCHEMA)
    got = G.generated(s, "bio_spans_test", "tokens", "tags", keep=("sent_id",))
    want = Q.entity_spans(s).select("id", "kind", "first", "last", "answer", "start", "context")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect()) and got.count() == 3


def test_holdout_and_summary(spark):
    rows = spark.range(700).withColumnRenamed("id", "doc_id")
    assert {r.split: r["count"] for r in C.carve_holdout(rows, 1).groupBy("split").count().collect()} == {"test": 70, "train": 630}
    assert C.carve_holdout(rows.limit(20), 1).filter("split = 'test'").count() == 20
    qa = spark.createDataFrame([("t", i, "s" if i % 2 else None, "same " * 20 if i < 3 else f"a{i}") for i in range(8)], "task string, id int, specialty string, answer string")
    got = Q.task_summary(qa, ["task"], F.size(F.split("answer", " ")), "specialty", "answer", "id").first()
    assert [tuple(x) for x in got.top5_specialties] == [("s", 4)] and got.n_specialties == 1
    assert [tuple(x) for x in got.answer_distribution_top5] == [(("same " * 20)[:30], 3), ("a3", 1), ("a4", 1), ("a5", 1), ("a6", 1)]
    step = spark.range(1).select(C.step_intervals(F.lit(7)).alias("x")).first().x
    assert (step.warmup_steps, step.save_steps) == (1, 1)


def test_joint_verdicts(spark):
    rows = [(0.5, True, True, 0.7, False), (-0.5, True, True, 0.3, False), (0.5, True, True, 0.3, False), (0.1, False, None, None, True), (0.1, False, False, 0.5, False), (0.5, True, None, None, False)]
    got = [r.v for r in spark.createDataFrame(rows, "dz double, p boolean, w boolean, r double, e boolean").select(S.joint_verdict("dz", "p", "w", "r", "e").alias("v")).collect()]
    assert got == ["PREFERRED", "WORSE", "MIXED", "EQUIVALENT", "no reliable difference", "MIXED"]


def test_repeated_chunks_are_encoded_once(spark):
    P = pytest.importorskip("public_tokenizers")
    from brindle.functions import encoder as E

    path = P.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([(1, "le chat dort " * 50)], "i int, text string").repartition(1)

    assert rows.select(vocab.token_count("text", path).alias("n")).first().n == len(E.encoder(path).ids(["le chat dort " * 50])[0]) // 4
