"""Paired tests, corrections, equivalence, ranks and verdicts: counts and statistics in the plan, p-values in vectorised UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import dist
from brindle.operators.order import numbered
from brindle.operators.resampling import poisson_bootstrap, signed_ranks, with_wilcoxon
from brindle.sources.scratch import shared_if_small, stored

# Two-sided 5 % critical values of the studentised range over sqrt(2), for 2 to 15 systems (Nemenyi).
NEMENYI_Q05 = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164, 11: 3.219, 12: 3.268, 13: 3.313, 14: 3.354, 15: 3.391}
Z90, Z95 = 1.644854, 1.959964


def paired(scores: DataFrame, reference: str, keys: list[str], item: str, value: str = "score", name: str = "model") -> DataFrame:
    """name, keys, item, x, r, d: each model's items beside the reference's."""
    ref = scores.filter(F.col(name) == reference).select(*keys, item, F.col(value).alias("r"))
    mine = scores.filter(F.col(name) != reference).select(name, *keys, item, F.col(value).alias("x"))
    return mine.join(ref, [*keys, item]).withColumn("d", F.col("x") - F.col("r"))


def paired_stats(pairs: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """n, means, delta, sd, t, dz with its standard error and 95 % interval, of groups of at least `least` pairs."""
    base = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.avg("r").alias("mean_r"), F.avg("d").alias("delta"), F.stddev_samp("d").alias("sd")).filter(F.col("n") >= least)
    flat = F.coalesce(F.col("sd"), F.lit(0.0)) == 0
    out = base.withColumns({"t": F.when(~flat, F.col("delta") / (F.col("sd") / F.sqrt("n"))), "dz": F.when(flat, 0.0).otherwise(F.col("delta") / F.col("sd"))})
    out = out.withColumn("dz_se", F.sqrt(1 / F.col("n") + F.col("dz") * F.col("dz") / (2 * F.col("n"))))
    return out.withColumns({"dz_lo": F.col("dz") - Z95 * F.col("dz_se"), "dz_hi": F.col("dz") + Z95 * F.col("dz_se")})


def with_p_values(stats: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Adds p_t, p_wilcoxon (from rank sums made in the plan) and p_primary."""
    w = with_wilcoxon(signed_ranks(pairs, by)).select(*by, "p_wilcoxon")
    out = stats.join(w, by).withColumn("p_t", dist.t_two_sided_udf("t", (F.col("n") - 1).cast("double")))
    return out.withColumn("p_primary", F.coalesce(F.nanvl("p_wilcoxon", F.lit(None).cast("double")), F.nanvl("p_t", F.lit(None).cast("double")), F.lit(1.0)))


def equivalence(stats: DataFrame, margin: float = 0.2) -> DataFrame:
    """Adds TOST by the normal approximation on dz (p_tost, equivalent) and by two t-tests with a margin of margin * sd (p_tost_t, equivalent_t)."""
    df = (F.col("n") - 1).cast("double")
    z = lambda edge: (F.col("dz") + edge) / F.col("dz_se")
    t = lambda edge: (F.col("delta") + edge * F.col("sd")) / (F.col("sd") / F.sqrt("n"))
    out = stats.withColumns({"p_tost": F.greatest(1 - dist.normal_cdf_udf(z(margin)), dist.normal_cdf_udf(z(-margin))), "equivalent": (F.col("dz") - Z90 * F.col("dz_se") > -margin) & (F.col("dz") + Z90 * F.col("dz_se") < margin)})
    out = out.withColumn("p_tost_t", F.when(F.coalesce("sd", F.lit(0.0)) == 0, 0.0).otherwise(F.greatest(1 - dist.t_cdf_udf(t(margin), df), dist.t_cdf_udf(t(-margin), df))))
    return out.withColumn("equivalent_t", F.col("p_tost_t") < 0.05)


def benjamini_hochberg(table: DataFrame, p: str, family: list[str], key: list[str], name: str = "q") -> DataFrame:
    """Adds step-up adjusted p-values within each family; null and NaN p are left out and stay null.

    Places and least values to the right go by range partitions, so a family of any size is spread over many tasks and
    costs as its rows do; a window that ends with the family would look at all later rows for each.
    """
    families = [F.col(c).alias(f"__f{i}") for i, c in enumerate(family)] or [F.lit(0).alias("__f0")]
    fam = [f"__f{i}" for i in range(len(families))]
    rows = table.select(F.struct(*table.columns).alias("__own"), *families, F.when(F.col(p).isNotNull() & ~F.isnan(p), F.col(p)).alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)])
    order = [*map(F.col, fam), F.col("__p").asc_nulls_last(), *[F.col(f"__k{i}") for i in range(len(key))]]
    placed = numbered(rows, order, "__at")
    sizes = stored(placed.groupBy(*fam).agg(F.min("__at").alias("__first"), F.count("__p").alias("__m")).select(F.struct(*fam).alias("__family"), "__first", "__m"), "families")
    met = placed.join(shared_if_small(sizes, 64), F.struct(*fam).eqNullSafe(F.col("__family")))
    raw = met.withColumn("__raw", F.col("__p") * F.col("__m") / (F.col("__at") - F.col("__first") + 1))
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(raw.repartitionByRange(n, "__at").withColumn("__part", F.spark_partition_id()), "adjusted")
    later = Window.partitionBy("__family").orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("__part", "__family").agg(F.min("__raw").alias("__r"))  # one row for each partition and family in it
    ends = ends.select(F.col("__part").alias("__q"), F.col("__family").alias("__g"), F.min("__r").over(later).alias("__later")).filter(F.col("__later").isNotNull())
    inside = Window.partitionBy("__part", "__family").orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = ranged.withColumn("__least", F.min("__raw").over(inside))
    # Only families that go on in a later partition are in `ends`: fewer than two for each partition.
    out = least.join(F.broadcast(ends), (F.col("__part") == F.col("__q")) & F.col("__family").eqNullSafe(F.col("__g")), "left")
    adjusted = F.least(F.lit(1.0), F.least("__least", "__later"))  # nulls are passed over
    return out.select("__own.*", F.when(F.col("__p").isNotNull(), adjusted).alias(name))


def bonferroni(table: DataFrame, p: str, family: list[str], name: str = "p_bonferroni") -> DataFrame:
    """Adds p times the family's count of p, at most 1; families are counted, not gathered."""
    sizes = table.groupBy(*family).agg(F.count(p).alias("__m"))
    if not family:
        met = table.join(F.broadcast(sizes))  # one row
    else:
        sizes = stored(sizes.select(F.struct(*family).alias("__family"), "__m"), "families")
        met = table.join(shared_if_small(sizes, 64), F.struct(*family).eqNullSafe(F.col("__family")))
    return met.select(*table.columns, F.least(F.lit(1.0), F.col(p) * F.col("__m")).alias(name))


def stars(p: Column | str) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def mcnemar_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """b (only x right), c (only r right), the raw p and p capped at 1."""
    counts = pairs.groupBy(*by).agg(F.count_if((F.col("x") > 0) & (F.col("r") <= 0)).alias("b"), F.count_if((F.col("x") <= 0) & (F.col("r") > 0)).alias("c"), F.count("*").alias("n"))
    return counts.withColumn("p_raw", dist.mcnemar_udf("b", "c")).withColumn("p", F.least(F.lit(1.0), "p_raw"))


def bootstrap(pairs: DataFrame, by: list[str], draws: int = 2000, seed: int = 42, item: str = "item") -> DataFrame:
    """n, ci_lo, ci_hi (2.5 and 97.5 %) and p_boot of the mean difference of each cell with three pairs or more."""
    return poisson_bootstrap(pairs, by, [item], draws=draws, seed=seed)


def zip_arrays(a: Column | str, b: Column | str) -> Column:
    """Array of struct(pos, left, right) of two arrays by position, as long as the shorter; null counts as empty."""
    a, b = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.array()) for c in (a, b))
    n = F.least(F.size(a), F.size(b))
    return F.transform(F.slice(a, F.lit(1), n), lambda x, i: F.struct(i.alias("pos"), x.alias("left"), F.get(b, i).alias("right")))


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows of two tables side by side by place (pos from 0) in their own orders, within groups if asked for; as many as the shorter side has.

    The columns to join are struct-valued: l and r.  Orders must be total; [] takes the order of the files and their
    rows.  A place is a running count by range partitions, so a group of any size is numbered by many tasks.
    """
    by = by or []

    def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
        whole = F.struct(*[F.col(c) for c in df.columns]).alias(name)
        if order:
            rows = df.select(*by, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], whole)
            order = [f"__o{i}" for i in range(len(order))]
        else:
            rows = df.select(*by, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"), whole)
            order = ["__file", "__row"]
        rows = numbered(rows, [*map(F.col, by), *map(F.col, order)], "__at")
        if not by:
            return rows.select(F.col("__at").alias("pos"), name)
        first = rows.groupBy(*by).agg(F.min("__at").alias("__first"))
        return rows.join(first, by).select(*by, (F.col("__at") - F.col("__first")).alias("pos"), name)

    return placed(left, left_order, "l").join(placed(right, right_order, "r"), [*by, "pos"])


def average_ranks(scores: DataFrame, item: list[str], value: str = "score", name: str = "model", ties: str = "average") -> DataFrame:
    """Mean rank (1 is best) of each model over items; ties by average or by name ("ordinal")."""
    w = Window.partitionBy(*item).orderBy(F.desc(value))
    if ties == "ordinal":
        rank = F.row_number().over(Window.partitionBy(*item).orderBy(F.desc(value), name)).cast("double")
    else:
        rank = F.rank().over(w) + (F.count("*").over(Window.partitionBy(*item, value)) - 1) / 2.0
    return scores.withColumn("__rank", rank).groupBy(name).agg(F.avg("__rank").alias("avg_rank"), F.count("*").alias("n_items"))


def friedman(scores: DataFrame, item: str, value: str = "score", name: str = "model") -> DataFrame:
    """n_items, k, chi2 (tie-corrected) and p over the items that all k models have."""
    k = scores.agg(F.count_distinct(name).alias("k"))
    full = scores.groupBy(item).agg(F.count_distinct(name).alias("c")).join(F.broadcast(k)).filter("c = k").select(item)  # one row
    rows = scores.join(full, item, "left_semi").groupBy(item, name).agg(F.first(value).alias("v"))
    w = Window.partitionBy(item).orderBy("v")
    ties = F.count("*").over(Window.partitionBy(item, "v"))
    ranked = rows.withColumns({"rk": F.rank().over(w) + (ties - 1) / 2.0, "tie": (ties * ties - 1).cast("double")})
    sums = ranked.groupBy(name).agg(F.sum("rk").alias("s"), F.count("*").alias("n"), F.sum("tie").alias("tie"))
    total = sums.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"), F.count("*").alias("k"), F.sum("tie").alias("tie"))
    chi = (12 * F.col("ss") / (F.col("n") * F.col("k") * (F.col("k") + 1)) - 3 * F.col("n") * (F.col("k") + 1)) / (1 - F.col("tie") / (F.col("n") * F.col("k") * (F.col("k") * F.col("k") - 1)))
    return total.select(F.col("n").alias("n_items"), "k", chi.alias("chi2")).withColumn("p", dist.chi2_sf_udf("chi2", (F.col("k") - 1).cast("double")))


def critical_difference(k: Column | str, n: Column | str) -> Column:
    """Nemenyi critical difference of average ranks, for up to 15 systems (null beyond)."""
    q = F.create_map(*[F.lit(x) for kv in NEMENYI_Q05.items() for x in kv])
    k, n = (F.col(c) if isinstance(c, str) else c for c in (k, n))
    return F.try_element_at(q, k.cast("int")) * F.sqrt(k * (k + 1) / (6.0 * n))


def verdict(delta: Column | str, q: Column | str, equivalent: Column | str) -> Column:
    d, q, e = (F.col(c) if isinstance(c, str) else c for c in (delta, q, equivalent))
    return F.when((q < 0.05) & (d > 0), "PREFERRED").when((q < 0.05) & (d < 0), "WORSE").when(e, "EQUIVALENT").otherwise("no reliable difference")


def joint_verdict(dz: Column | str, paired_sig: Column | str, duel_sig: Column | str, win_rate: Column | str, equivalent: Column | str) -> Column:
    """The verdict of two paradigms: both significant and concordant, equivalent, neither significant (a missing duel counts so), or mixed."""
    z, p, w, r, e = (F.col(c) if isinstance(c, str) else c for c in (dz, paired_sig, duel_sig, win_rate, equivalent))
    concordant = p & F.coalesce(w, F.lit(False)) & ((z > 0) == (r > 0.5))
    return F.when(concordant & (z > 0), "PREFERRED").when(concordant, "WORSE").when(e & ~p, "EQUIVALENT").when(~p & ~F.coalesce(w, F.lit(False)), "no reliable difference").otherwise("MIXED")


def verdict_counts(table: DataFrame, by: list[str], delta: str = "delta", p: str = "p", effect: str = "dz") -> DataFrame:
    """wins, significant wins and losses, ties (less than 0.005), mean delta, mean effect and median p."""
    d, sig = F.col(delta), F.col(p) < 0.05
    return table.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(sig & (d > 0)).alias("sig_wins"), F.count_if(sig & (d < 0)).alias("sig_losses"), F.count_if(F.abs(d) < 0.005).alias("ties"),
        F.avg(d).alias("mean_delta"), F.avg(effect).alias("mean_effect"), F.percentile(p, F.lit(0.5)).alias("median_p"),
    )


def reviewer_verdict(sig_wins: Column | str, sig_losses: Column | str) -> Column:
    w, x = (F.col(c) if isinstance(c, str) else c for c in (sig_wins, sig_losses))
    return F.when((w >= 3) & (x == 0), "sig_better").when(w > x, "mixed_better").when((w == 0) & (x == 0), "tied").when(x > w, "worse").otherwise("mixed")
