"""N-gram features travel as one list for each document; weights equal the definition."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pytest

from brindle.operators import corpus as C


def grams(text):
    w = re.findall(r"\w{2,}", (text or "").lower())
    return [int.from_bytes(hashlib.md5(g.encode()).digest()[:4], "big") % 64 for g in [*w, *(f"{x} {y}" for x, y in zip(w, w[1:]))]]


def test_weights_equal_the_definition_from_one_row_a_document(spark):
    texts = ["Le chat dort", "le chat dort encore, le chat", None, "", "x y", "été à Paris"]
    raw = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    target = spark.createDataFrame([(0, "le chat"), (1, "paris en été")], "item_id long, text string")
    rows = C.hashed_ngrams(raw, features=64).collect()
    assert len(rows) == len(texts) and {r.doc_id: list(r.f) for r in rows} == {i: grams(t) for i, t in enumerate(texts)}
    r, t = Counter(sum(map(grams, texts), [])), Counter(grams("le chat") + grams("paris en été"))
    lr = {f: math.log((t[f] + 1) / (sum(t.values()) + 64)) - math.log((r[f] + 1) / (sum(r.values()) + 64)) for f in r}
    got = {x.doc_id: x.weight for x in C.dsir_weights(raw, target, features=64).collect()}
    assert got == {i: pytest.approx(sum(lr[f] for f in grams(x)) / max(1, len(grams(x)))) for i, x in enumerate(texts)}
