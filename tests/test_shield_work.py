import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from brindle.operators import near_dup as N
from brindle.operators import reports as R
from brindle.streaming import shield


def _texts(n):
    base = [f"w{i}" for i in range(40)]
    return [(i, " ".join(base[: 20 + i % 15] + [f"o{i}_{j}" for j in range(0 if i % 3 else 30)])) for i in range(n)]


def test_documents_that_meet_no_test_item_get_no_signature(spark):
    """Only the permutations that bands begin with are made for them, and the result is that of all."""
    rows = spark.createDataFrame([*_texts(60), (60, None), (61, " \n"), (62, "one two"), *[(63 + j, " ".join(f"own{j}_{i}" for i in range(9))) for j in range(5)]], "doc_id long, text string")
    index = N.lsh_index(rows.filter("doc_id IN (4, 9, 62)"), 0.8).withColumnRenamed("doc_id", "t")
    every = N.lsh_index(rows, 0.8)
    some = N.lsh_index(rows, 0.8, near=N.band_heads(index, 0.8))
    assert 3 <= some.select("doc_id").distinct().count() < every.select("doc_id").distinct().count()
    hit = {r.doc_id for r in every.join(index, ["band", "band_hash"], "left_semi").collect()}
    want = set(range(68)) - hit
    assert {4, 9, 62} <= hit and len(want) > 10
    for test in (index, index.drop("head")):
        assert {r.doc_id for r in N.leakage_filter(rows, test).collect()} == want
        assert {r.doc_id for r in shield.shield_stream(rows, test).collect()} == want
    assert N.band_heads(index.filter("false"), 0.8)[1].value[0].tolist() == []
    assert N.leakage_filter(rows, index.filter("false")).count() == 68


def test_the_recheck_runs_the_shield_once(spark):
    rows = spark.createDataFrame(_texts(30), "doc_id long, text string")
    index = N.lsh_index(rows.filter("doc_id = 4"), 0.8)
    train = N.leakage_filter(rows, index)
    got = R.recheck_shield(train, index, sample=5)
    assert tuple(got.first()) == (5, 0)
    assert "shield-sample" in "".join(got.inputFiles()) and not set(rows.inputFiles()) & set(got.inputFiles())


def test_shingles_are_split_at_ascii_white_space(spark):
    text = "a b c d\x0be\x1cf\fg\r\nh \u0085 i\tj k é"
    words = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text) if x]
    h = np.array([int.from_bytes(hashlib.md5(" ".join(words[i : i + 5]).encode()).digest()[:4], "big") % 2147483647 for i in range(len(words) - 4)])
    want = [min((int(x) * a + b) % N.PRIME for x in h) for a, b in N.multipliers(128)]
    assert N.signatures(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.col("sig")).first()[0] == want
