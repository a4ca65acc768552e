"""Bootstrap and signed ranks as plan expressions: no cell's differences meet in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import dist
from brindle.operators.order import running

#: A uniform 32-bit number at or above the k-th of these draws more than k: the distribution of a Poisson variable of mean 1.
POISSON = [math.floor(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def poisson(u: Column) -> Column:
    """How often a row is drawn, for a uniform 32-bit number."""
    return sum(((u >= t).cast("int") for t in POISSON[1:]), (u >= POISSON[0]).cast("int"))


def poisson_bootstrap(pairs: DataFrame, by: list[str], item: list[str], *, draws: int = 2000, seed: int = 42) -> DataFrame:
    """by, n, ci_lo, ci_hi (2.5 and 97.5 %), p_boot of the mean of d; a cell of fewer than three pairs has nulls.

    Each replicate draws every pair a Poisson number of times, keyed by (seed, four replicates, cell, item), so that a
    retried task draws the same and the rows of a cell can lie anywhere: what moves is one row of sums for each task,
    cell and four replicates.  A replicate that draws nothing counts in no quantile.  Null d takes no part; a repeated
    item draws alike.
    """
    rows = pairs.filter(F.col("d").isNotNull()).select(*by, F.concat_ws("|", *[F.col(c).cast("string") for c in (*by, *item)]).alias("__item"), "d")
    spread = rows.withColumn("__four", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // 4) - 1))))
    hashed = spread.withColumn("__md5", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__four").cast("string"), "__item")))
    drawn = hashed.withColumns({f"__w{j}": poisson(F.conv(F.substring("__md5", 1 + 8 * j, 8), 16, 10).cast("long")) for j in range(4)})
    sums = drawn.groupBy(*by, "__four").agg(F.count("*").alias("n"), *[F.sum(f"__w{j}").alias(f"__k{j}") for j in range(4)], *[F.sum(F.col(f"__w{j}") * F.col("d")).alias(f"__s{j}") for j in range(4)])
    each = F.array(*[F.struct((F.col("__four") * 4 + j).alias("r"), F.when(F.col(f"__k{j}") > 0, F.col(f"__s{j}") / F.col(f"__k{j}")).alias("m")) for j in range(4)])
    means = sums.select(*by, "n", F.explode(each).alias("__x")).select(*by, "n", "__x.*").filter(F.col("r") < draws)
    m, enough = F.col("m"), F.max("n") >= 3
    tail = lambda c: F.count_if(c) / F.count("m")
    return means.groupBy(*by).agg(
        F.max("n").alias("n"), F.when(enough, F.percentile("m", F.lit(0.025))).alias("ci_lo"), F.when(enough, F.percentile("m", F.lit(0.975))).alias("ci_hi"), F.when(enough, F.least(F.lit(1.0), 2 * F.least(tail(m <= 0), tail(m >= 0)))).alias("p_boot"),
    )


def signed_ranks(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n_pairs, n (differences other than 0), w_plus (rank sum of the positive ones, ties by average), ties (sum of t^3 - t).

    Sizes are counted first, so equal ones are one row; their ranks in all cells at once are running counts in the order
    of (cell, size) by range partitions, less the count before the cell.
    """
    totals = pairs.groupBy(*by).agg(F.count("d").alias("n_pairs"))
    sizes = pairs.filter("d != 0").groupBy(*by, F.abs("d").alias("__size")).agg(F.count("*").alias("__k"), F.count_if(F.col("d") > 0).alias("__plus"))
    ranked = running(sizes, [*map(F.col, by), F.col("__size")], {"__before": F.col("__k")})
    k, plus = F.col("__k"), F.col("__plus")
    own = F.sum(plus * (F.col("__before") + (k + 1) / 2.0)) - F.min("__before") * F.sum(plus)
    found = ranked.groupBy(*by).agg(F.sum(k).alias("n"), own.alias("w_plus"), F.sum(k * k * k - k).alias("ties"))
    same = [totals[c].eqNullSafe(found[c]) for c in by]
    return totals.join(found, same, "left").select(*[totals[c] for c in by], "n_pairs", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n", "w_plus", "ties")])


def with_wilcoxon(ranks: DataFrame) -> DataFrame:
    """Adds p_wilcoxon: exact up to 50 differences without ties and zeros, else by the normal approximation with ties; 1 if all are 0."""
    return ranks.withColumn("p_wilcoxon", dist.signed_rank_udf("n", "n_pairs", "w_plus", "ties"))
