"""Item metrics of predictions against gold answers."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from brindle.functions.text import bind, col, normalize_answer


def set_accuracy(pred: Column | str, gold: Column | str) -> Column:
    """1 if the comma-separated sets are equal; two empty strings are."""
    parts = lambda c: F.array_sort(F.array_distinct(F.split(F.coalesce(col(c), F.lit("")), ",")))
    return (parts(pred) == parts(gold)).cast("int")


def hamming(pred: Column, gold: Column, n: Column | int) -> Column:
    """Share of the first n letters on which two letter arrays agree."""
    n = F.lit(n) if isinstance(n, int) else n
    inside = lambda a: F.filter(a, lambda x: (F.ascii(x) - 65 >= 0) & (F.ascii(x) - 65 < n))
    wrong = F.size(F.array_except(inside(pred), inside(gold))) + F.size(F.array_except(inside(gold), inside(pred)))
    return (n - wrong) / n


def exact_match(pred: Column | str, gold: Column | str) -> Column:
    return (normalize_answer(pred) == normalize_answer(gold)).cast("int")


def multiset_f1(pred: Column, gold: Column) -> Column:
    """F1 of the overlap of two token arrays as multisets; both empty 1, one empty 0."""
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))

    def score(both: Column) -> Column:
        p, g = both["p"], both["g"]
        same = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda s, w: s + F.least(count(p, w), count(g, w)))
        return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(2.0 * same / (F.size(p) + F.size(g)))

    return bind(F.struct(pred.alias("p"), gold.alias("g")), score)


def token_f1(pred: Column | str, gold: Column | str) -> Column:
    """Multiset overlap of normalised tokens."""
    tokens = lambda c: F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")
    return multiset_f1(tokens(pred), tokens(gold))


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l_score(pred: str, gold: str) -> float:
    """F of the longest common subsequence of runs of [a-z0-9]."""
    import re

    p, g = (re.findall("[a-z0-9]+", (s or "").lower()) for s in (pred, gold))
    if not p or not g:
        return 0.0
    n = _lcs(p, g)
    return 2 * n / (len(p) + len(g)) if n else 0.0


def bleu4_score(pred: str, gold: str) -> float:
    """Sentence BLEU-4 with one reference on white-space tokens; zero counts become 0.1 over their denominator."""
    p, g = (pred or "").split(), (gold or "").split()
    if not p or not g:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        have = Counter(tuple(p[i : i + n]) for i in range(len(p) - n + 1))
        want = Counter(tuple(g[i : i + n]) for i in range(len(g) - n + 1))
        hits, total = sum(min(c, want[k]) for k, c in have.items()), max(1, sum(have.values()))
        if n == 1 and hits == 0:
            return 0.0
        logs += math.log(hits / total if hits else 0.1 / total) / 4
    return math.exp(logs + (0 if len(p) > len(g) else 1 - len(g) / len(p)))


@F.pandas_udf(DoubleType())
def rouge_l(pred: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([rouge_l_score(a, b) for a, b in zip(pred, gold)])


@F.pandas_udf(DoubleType())
def bleu4(pred: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([bleu4_score(a, b) for a, b in zip(pred, gold)])
