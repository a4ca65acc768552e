"""Judge scores and duels: consensus, rollups, agreement, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.dist import sign_test_udf, t_quantile_udf
from brindle.functions.text import combine_passes


def axis_means(scores: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """Means of the axes and of the composite over valid rows, and the valid share."""
    valid = F.col("composite").isNotNull()
    return scores.groupBy(*by).agg(*[F.avg(F.when(valid, F.col(a))).alias(a) for a in [*axes, "composite"]], (F.count_if(valid) / F.greatest(F.count("*"), F.lit(1))).alias("valid_share"))


def axis_breakdown(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(value).alias("n"))


def consensus(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Mean over the judges that scored an item, and how many did."""
    return scores.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("score"), F.count("*").alias("n_judges"))


def pointwise_summary(scores: DataFrame, by: list[str], item: list[str], judges: list[str], value: str = "score") -> DataFrame:
    """Consensus mean and sd, beside each judge's own mean."""
    agreed = consensus(scores, [*by, *item], value).groupBy(*by).agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
    own = scores.groupBy(*by).pivot("judge", judges).agg(F.avg(value))
    return agreed.join(own, by)


def mean_of_means(scores: DataFrame, by: list[str], judge: str = "judge", value: str = "score") -> DataFrame:
    return scores.groupBy(*by, judge).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.avg("m").alias("mean"))


def settle_duels(duels: DataFrame) -> DataFrame:
    """duels with winner and consistent from their two passes."""
    return duels.withColumn("__c", combine_passes("verdict_ab", "verdict_ba")).select("*", F.col("__c.winner").alias("winner"), F.col("__c.consistent").alias("consistent")).drop("__c")


def duel_rollup(settled: DataFrame, by: list[str]) -> DataFrame:
    """wins, losses, ties, n (valid), n_attempted and position consistency."""
    is_ = lambda w: F.count_if(F.col("winner") == w)
    return settled.groupBy(*by).agg(
        is_("challenger").alias("wins"), is_("opponent").alias("losses"), is_("tie").alias("ties"), F.count("winner").alias("n"), F.count("*").alias("n_attempted"),
        (F.count_if(F.col("consistent") & F.col("winner").isNotNull()) / F.greatest(F.lit(1), F.count("winner"))).alias("position_consistency"),
    )


def preference(rollup: DataFrame) -> DataFrame:
    """Adds win_rate (null without decided duels) and net_preference."""
    decided = F.col("wins") + F.col("losses")
    return rollup.withColumns({"win_rate": F.try_divide(F.col("wins"), decided), "net_preference": (F.col("wins") - F.col("losses")) / F.greatest(F.lit(1), F.col("n"))})


def pooled(rollup: DataFrame, by: list[str]) -> DataFrame:
    """Rollups of several referees added up, with preferences derived again."""
    return preference(rollup.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("wins", "losses", "ties", "n")]))


def with_sign_test(rollup: DataFrame) -> DataFrame:
    return rollup.withColumn("p_sign", sign_test_udf("wins", "losses"))


def coverage(scores: DataFrame, by: list[str], value: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("covered"))


def dimension_delta(scores: DataFrame, reference: str, axis: str = "axis", shot: str = "n_shot", value: str = "score") -> DataFrame:
    """Mean over shots of the difference of means to the reference model, per model and axis."""
    means = scores.groupBy("model", shot, axis).agg(F.avg(value).alias("m"))
    ref = means.filter(F.col("model") == reference).select(shot, axis, F.col("m").alias("__r"))
    return means.filter(F.col("model") != reference).join(ref, [shot, axis]).groupBy("model", axis).agg(F.avg(F.col("m") - F.col("__r")).alias("delta"))


def agreement(scores: DataFrame, item: list[str], one: str, two: str, value: str = "score") -> DataFrame:
    """n, Pearson, Spearman (average ranks) and mean offset of two judges on the items both scored."""
    both = scores.filter(F.col("judge").isin(one, two)).groupBy(*item).agg(F.avg(F.when(F.col("judge") == one, F.col(value))).alias("x"), F.avg(F.when(F.col("judge") == two, F.col(value))).alias("y")).dropna(subset=["x", "y"])
    # average ranks from the counts of distinct values: as many rows as scores have values
    for c in ("x", "y"):
        counts = both.groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__k"))
        ranks = counts.select("__v", (F.sum("__k").over(Window.orderBy("__v")) - (F.col("__k") - 1) / 2).alias(f"r{c}"))
        both = both.join(ranks, both[c] == ranks["__v"]).drop("__v")
    return both.agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.avg(F.col("x") - F.col("y")).alias("offset"))


def kappa(labels: DataFrame, a: str, b: str) -> DataFrame:
    """n and Cohen's kappa of two label columns."""
    cells = labels.groupBy(a, b).agg(F.count("*").alias("k"))
    total = cells.agg(F.sum("k").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("k")).otherwise(0)).alias("same"))
    rows = cells.groupBy(F.col(a).alias("l")).agg(F.sum("k").alias("ra"))
    cols = cells.groupBy(F.col(b).alias("l")).agg(F.sum("k").alias("rb"))
    chance = rows.join(cols, "l").agg(F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return total.join(F.broadcast(chance)).select("n", F.try_divide(po - pe, 1 - pe).alias("kappa"))  # one row each


def seed_summary(metrics: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """mean, sample sd (null for one), n and the half width of the 95 % t interval."""
    out = metrics.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return out.withColumn("ci95", t_quantile_udf(F.lit(0.975), (F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt("n"))


def once_per_seed(metrics: DataFrame, vanilla: str, seed: str = "seed") -> DataFrame:
    """Rows of the vanilla model stay for the first seed only."""
    first = metrics.agg(F.min(seed).alias("__first"))
    return metrics.join(F.broadcast(first)).filter((F.col("model") != vanilla) | (F.col(seed) == F.col("__first"))).drop("__first")  # one row


def numeric_leaves(df: DataFrame, prefix: str = "") -> list[tuple[str, Column]]:
    """(dotted name, column as double) of all numeric fields, nested ones too; booleans are not numbers."""
    from pyspark.sql import types as T

    out: list[tuple[str, Column]] = []

    def walk(kind: T.StructType, path: str) -> None:
        for f in kind:
            name = f"{path}{f.name}"
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, name + ".")
            elif isinstance(f.dataType, T.NumericType):
                out.append((prefix + name, F.col(name).cast("double")))

    walk(df.schema, "")
    return out


def unpivot_numbers(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, value rows of all finite numeric leaves."""
    pairs = [F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in numeric_leaves(df) if n not in keys]
    rows = df.select(*keys, F.explode(F.array(*pairs)).alias("v")).select(*keys, "v.metric", "v.value")
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
