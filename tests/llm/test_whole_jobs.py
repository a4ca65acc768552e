"""Whole-job tests of the operators: inputs on which an earlier version lost results."""

import random

import corpus_pipeline
import numpy as np
import pytest
from test_llm_operators import components

from brindle.llm import chat, language, licences, ngram_join, substring, tokens


def test_ngram_join_of_unequal_sizes(spark):
    rng, rows = random.Random(8), []
    for g in range(150):  # a text and cut or extended copies of it, at a Jaccard of about 0.8
        w = [f"g{g}w{i}" for i in range(rng.randrange(24, 90))]
        n = len(w) - 4
        for share in (0.8, 0.85):
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[: round(n * share) + 4]))]
            w = w[: round(n * share) + 4] + [f"own{len(rows)}x{i}" for i in range(rng.randrange(3))]
    # what the copies do not share is made live by texts that share only that
    rows += [(len(rows) + i, " ".join(t.split()[-rng.randrange(8, 14) :]) + " " + " ".join(f"z{i}y{j}" for j in range(30))) for i, (_, t) in enumerate(list(rows))]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in got.collect()) == components(rows)


def test_ngram_join_of_large_sets(spark):
    rng, rows = random.Random(3), []
    for g in range(12):  # long texts that share a passage, and copies of them cut to a Jaccard about 0.8
        w = [f"g{g}w{i}" for i in range(rng.choice([900, 1500, 3100, 6500]))] + [f"shared{i}" for i in range(400)]
        for share in (1.0, 0.79, 0.805, 0.9):
            rows.append((len(rows), " ".join(w[: round(len(w) * share)])))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in got.collect()) == components(rows)
    assert [ngram_join.wide_words(n) for n in (800, 801, 1600, 3200, 10**7)] == [0, 32, 64, 128, 4096]
    g = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wide, small = ngram_join.parity_map(g, 256), ngram_join.parity_map(g, 16)
    assert np.bitwise_xor.reduce(wide.reshape(-1, 16), axis=0).tolist() == small.tolist()


def test_substring_dedup_removes_whole_passages(spark):
    rng, rows, want = random.Random(4), [], {}
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for g in range(60):
        passage, cut = own(rng.choice([50, 51, 60, 77, 120, 300])), rng.randrange(30)
        for i, p in enumerate([passage, passage, passage[cut:] if len(passage) - cut >= 50 else passage]):  # a third text that has a part only
            a, b = own(rng.randrange(1, 60)), own(rng.randrange(1, 60))
            want[len(rows)] = a + b if i else a + p + b
            rows.append((len(rows), " ".join(a + p + b)))
    copied = " ".join(own(80))
    rows += [(1000, copied), (1001, copied), (1002, " ".join(own(9)) + " " + copied), (None, copied), (1003, None), (1004, "")]
    want |= {1000: copied.split(), 1001: [], 1002: rows[-4][1].split()[:9], None: [], 1003: None, 1004: []}
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), whole_passages=True).collect()
    assert {r.doc_id: None if r.text is None else r.text.split() for r in got} == want and len(got) == len(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedup_substrings(empty, whole_passages=True).count() == 0


def test_short_lines_that_repeat_go(spark, tmp_path):
    rng = random.Random(6)
    own = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(30))
    lines = ["All rights reserved.", "one", "a line of seven words in all", "\tTwo  words"]
    rows = [(i, "\n".join(x for line in rng.sample(lines, len(lines)) for x in (own(), line)), "en", "s", 1) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: [x for x in t.split("\n") if x not in lines] if i else t.split("\n") for i, t, *_ in rows}
    got = substring.op8_substring_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text.split() for r in got} == {i: " ".join(x).split() for i, x in want.items()}
    got = corpus_pipeline.substring_dedup(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()
    assert {r.doc_id: r.text.split() for r in got} == {i: " ".join(x).split() for i, x in want.items()}


def test_long_licence_expressions_count_whole():
    names = ["MIT", "Apache-2.0", "BSD-3-Clause"] * 200
    assert licences.evaluate(" AND ".join([*names, "GPL-3.0"])) == (0.3, ["mit", "apache", "bsd"] * 200 + ["gpl"])
    assert licences.evaluate("(" + " OR ".join(["GPL-3.0"] * 400) + ") AND (MIT OR GPL-2.0) AND (MIT") == (0.3, ["gpl"] * 400 + ["mit", "gpl", "mit"])
    assert licences.evaluate("(" * 300 + "MIT" + ")" * 300 + " words") == (1.0, ["mit"])
    assert licences.evaluate("(" + " OR ".join(["MIT"] * 400)) == (1.0, ["mit"] * 400) and licences.evaluate("((") is None
    assert licences.evaluate("(MIT OR Apache-2.0") == (1.0, ["mit", "apache"]) and licences.evaluate("GPL-2.0 AND ((") == (0.3, ["gpl"])
    assert licences.evaluate("MIT AND (GPL-2.0 OR") == (0.3, ["mit", "gpl"]) and licences.evaluate("MIT OR Apache-2.0 GPL-2.0") == (1.0, ["mit", "apache"])
    labels, score = licences.Scanner(licences.BASE).scan("SPDX-License-Identifier: " + " AND ".join([*names, "AGPL-3.0"]) + "\nx")[3:]
    assert len(labels) == 601 and labels[-1] == "agpl" and score == 0.2


def test_rare_languages_are_learned(spark):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(["the", "thing", "other"]) + rng.choice("aeiou") for _ in range(20)), "aa") for i in range(3000)]
    data += [(3000 + i, "żółw źdźbło ćma ŝĝ " * 9, "zz") for i in range(4)] + [(7, "ñañu ñoño " * 9, "yy")] * 5  # repeated rows with one id
    model = language.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), fit_texts=30)
    assert model.languages == ["aa", "yy", "zz"]


def test_language_fit_reads_whole_texts(spark):
    assert language.frequencies("", 3)[0].tolist() == []
    long = "abc " * 400_000 + "ąę"  # more than one block
    at, share = language.frequencies(long, 3)
    raw = np.frombuffer(long.encode(), np.uint8)
    want = np.concatenate([np.bincount(language.ngram_buckets(raw, n)[n - 1 :], minlength=language.BUCKETS) / len(raw) for n in (1, 2, 3)])
    assert at.tolist() == np.flatnonzero(want).tolist() and np.allclose(share, want[at])
    head = "zz zz " * 5000  # languages that differ only beyond 20,000 bytes
    data = [(i, head + (f"ab{i} " if i % 2 else f"xy{i} ") * 5000, "aa" if i % 2 else "bb") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.predict(df, language.fit(df)).collect()}
    assert got == {i: k for i, _, k in data}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(name):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path(name)
    library, enc, rng = Tokenizer.from_file(path), tokens.Encoder(path, 20_000), random.Random(9)  # memory emptied again and again
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u3000", "'s", "'LL", "é", "e\u0301", "İ", "ß", "Σς", "ſ", "中文", "ع", "👍🏽", "\u200d", "0", "12", "½", "²", "a", "Word", "the", "...", "\\", "x" * 200, "\x00", "\ufeff"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x1F000)])) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    texts += ["", "ab" * 400_000, "word " * 60_000 + "<|endoftext|>"]
    for lo in range(0, len(texts), 500):
        got = enc.ids(texts[lo : lo + 500])
        for t, ids in zip(texts[lo : lo + 500], got):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)[:200]
    assert max(map(len, enc.cache)) <= tokens.CACHE_CHUNK


def test_fingerprints_choose_the_mapping(spark):
    one = spark.createDataFrame([(1, 0, "user", "a", "x", "y")], "conv_id long, turn long, role string, text string, content string, prompt string")
    two = spark.createDataFrame([("b", 1, "user", 0)], "content string, conversation_id long, role string, position long")
    assert [tuple(t) for t in chat.turns_of_rows(one).first().turns] == [("user", "a")]
    assert [tuple(t) for t in chat.turns_of_rows(two).first().turns] == [("user", "b")]
    nested = spark.createDataFrame([], "a struct<b: array<struct<c: int>>, d: int>, e string")
    assert chat.schema_paths(nested.schema) == ["a", "a.b", "a.b.c", "a.d", "e"]
    with pytest.raises(ValueError):
        chat.turns_of_rows(nested)
    assert chat.turns_of_rows(one.limit(0)).count() == 0


def test_layouts_of_one_table(spark):
    records = [
        '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 3, "input": 4}', '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}',
        '{"instruction": "a", "input": "", "output": "b", "prompt": 7}', '{"messages": [{"role": "user", "content": "a"}, {"from": "gpt", "value": "b"}]}', '{"other": 1}', "broken",
    ]
    rows = [(10 + i, None, None, None, r, "x") for i, r in enumerate(records)]
    rows += [(1, 1, "assistant", "b", None, "x"), (1, 0, "user", "a", None, "x"), (None, 0, "user", "a", None, None), (None, 1, "assistant", "b", None, None), (2, None, None, None, None, None), (3, 0, "user", "a", None, None), (3, 0, "user", "a", None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string, turns string").repartition(4)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.conversations(table, "record").collect()}
    same = [("user", "a"), ("assistant", "b")]
    assert got == {1: same, 10: same, 11: same, 12: same, 13: same, None: same, 2: [("", "")], 3: [("user", "a")] * 2}


def test_the_query_goes_through_fingerprints(spark, tmp_path):
    table = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    out = chat.op5_chat_formatting(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "Python" not in plan
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in out.collect()} == {1: (2, 0), -7: (2, 21)}
