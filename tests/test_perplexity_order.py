"""Unigram perplexities are sums in the order of the text, to the last bit."""

from __future__ import annotations

import math
import random

from brindle.operators import corpus as C


def test_perplexity_adds_in_the_order_of_the_text(spark, monkeypatch):
    draw = random.Random(1)
    texts = [" ".join(f"w{int(draw.paretovariate(0.7))}" for _ in range(300)) for _ in range(40)]
    texts += texts[:5] + ["", "only once"]
    words = [t.split() for t in texts]
    c = {}
    for w in sum(words, []):
        c[w] = c.get(w, 0) + 1
    total = float(sum(c.values()) + len(c))
    want = []
    for own in words:
        s = 0.0
        for w in own:
            s += -math.log((c[w] + 1.0) / total)
        want.append(math.exp(min(20.0, s / max(1, len(own)))))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ppl for r in C.unigram_perplexity(rows).collect()}
    assert [got[i] for i in range(len(texts))] == want  # to the last bit
    monkeypatch.setattr(C, "VOCABULARY_BYTES", 20 * 48)  # rarer repeated words are shuffled
    got = {r.doc_id: r.ppl for r in C.unigram_perplexity(rows).collect()}
    assert all(math.isclose(got[i], w, rel_tol=1e-12) for i, w in enumerate(want))
