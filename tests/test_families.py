"""Step-up adjusted p-values by range partitions."""

from __future__ import annotations

import random

from brindle.operators import stats as S


def test_one_long_family_is_not_quadratic_and_equals_the_definition(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice([None, "a", "b"]) if i % 50 == 0 else "c", draw.choice([None, float("nan")]) if i % 97 == 0 else round(draw.random(), 3)) for i in range(3000)]
    table = spark.createDataFrame(rows, "k long, fam string, p double")
    for family in (["fam"], []):
        out = S.benjamini_hochberg(table, "p", family, ["k"])
        plan = out._jdf.queryExecution().executedPlan().toString().lower()
        assert "unboundedfollowing" not in plan and "unspecifiedframe$())) windowspecdefinition(fam" not in plan
        got = {r.k: r.q for r in out.collect()}
        assert len(got) == 3000
        for f in {r[1] for r in rows} if family else {0}:
            own = sorted((p, k) for k, g, p in rows if p is not None and p == p and (not family or g == f))
            least = 1.0
            for i in range(len(own), 0, -1):
                p, k = own[i - 1]
                least = min(least, p * len(own) / i)
                assert got[k] == least
        assert all(got[k] is None for k, _, p in rows if p is None or p != p)
