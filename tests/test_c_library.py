"""Exponentials of the C library, scaled rounding, and runs of articles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brindle.functions import libm
from brindle.functions import metrics as M
from brindle.operators import reports as R


def test_exponentials_are_those_of_the_c_library(spark):
    losses = [i * 0.00491 for i in range(4000)] + [None, 20.0, 1000.0, float("nan")]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(losses)], "i int, loss double")
    got = [r.p for r in rows.select("i", R.perplexity_of_loss("loss").alias("p")).orderBy("i").collect()]
    assert got == [math.exp(x) if x is not None and x < 20 else math.inf for x in losses]
    r = rows.limit(1).select(libm.scaled_round(F.lit(1.00005), 4).alias("up"), libm.scaled_round(F.lit(-2.5), 0).alias("away"), libm.scaled_round(F.lit(math.inf), 4).alias("inf")).first()
    assert tuple(r) == (math.floor(1.00005 * 1e4 + 0.5) / 1e4, -3.0, math.inf)


def test_every_article_of_a_run_goes(spark):
    r = spark.range(1).select(M.token_f1(F.lit("queai les la de de fin"), F.lit("queai fin")).alias("f1")).first()
    assert r.f1 == 1.0
