"""Registries, matchups, differences by seed, forgetting, and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import dist, libm
from brindle.functions.text import clean_text, col, fixed
from brindle.operators import stats as S
from brindle.operators.near_dup import leakage_filter
from brindle.operators.order import numbered, shuffled, take_first
from brindle.sources.scratch import stored

# The task suffixes of model names, and the assumed item standard deviations of cells without items.
SUFFIXES = ("DAPT", "MCQA", "ExtQA", "AbsQA", "Unified")
ITEM_SD, ITEM_SD_ABSQA = 0.45, 0.90


def task_suffix(name: Column | str) -> Column:
    """The known task suffix that a model's name ends with, else null."""
    return F.nullif(F.regexp_extract(col(name), f"-({'|'.join(SUFFIXES)})$", 1), F.lit(""))


def current_referees(results: DataFrame, registry: DataFrame, judge: str = "judge") -> DataFrame:
    """Results of judges that the registry still names."""
    return results.join(registry.select(judge).distinct(), judge, "left_semi")


def purge_once(spark: SparkSession, folder: str, pattern: str, marker: str) -> int:
    """Delete the files of a folder that match the glob, unless the marker file is there; then write the marker.  The number deleted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs, mark = path.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(path, marker)
    if fs.exists(mark):
        return 0
    old = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, pattern)) or []
    for status in old:
        fs.delete(status.getPath(), False)
    fs.create(mark).close()
    return len(old)


def human_time(seconds: Column | str) -> Column:
    """Seconds, minutes or hours with their unit."""
    s = col(seconds)
    return F.when(s < 60, F.concat(fixed(s, 1), F.lit("s"))).when(s < 3600, F.concat(fixed(s / 60, 1), F.lit("m"))).otherwise(F.concat(fixed(s / 3600, 2), F.lit("h")))


def stamp(time: Column | str) -> Column:
    return F.date_format(col(time), "yyyyMMdd_HHmmss")


def target_texts(rows: DataFrame, *columns: str) -> DataFrame:
    """text: the columns that are not null, joined and cleaned; empty ones go."""
    return rows.withColumn("text", clean_text(F.concat_ws(" ", *columns))).filter("text != ''")


def matchups(models: DataFrame, perplexity: str, noppl: str, vanilla: str, model: str = "model") -> DataFrame:
    """challenger, opponent, axis of the duels among the models present: A and B against vanilla, C between adapters of one suffix."""
    names = models.select(F.col(model).alias("m")).distinct()
    a, b, v = names.filter(F.col("m").startswith(perplexity)), names.filter(F.col("m").startswith(noppl)), names.filter(F.col("m") == vanilla).select(F.col("m").alias("opponent"))
    against = lambda rows, axis: rows.join(F.broadcast(v)).select(F.col("m").alias("challenger"), "opponent", F.lit(axis).alias("axis"))  # noqa: E731  one row at most
    same = a.select(F.col("m").alias("challenger"), task_suffix("m").alias("s")).join(b.groupBy(task_suffix("m").alias("s")).agg(F.max("m").alias("opponent")), "s")
    return against(a, "A_PPL_vs_Vanilla").unionByName(against(b, "B_NoPPL_vs_Vanilla")).unionByName(same.select("challenger", "opponent", F.lit("C_PPL_vs_NoPPL").alias("axis")))


def seed_differences(metrics: DataFrame, a: str, b: str, keys: list[str], seed: str = "seed", value: str = "value") -> DataFrame:
    """adapter, keys, seed, d: model a-X minus model b-X on the seeds that both have."""
    side = lambda start, name: metrics.filter(F.col("model").startswith(start + "-")).select(task_suffix("model").alias("adapter"), *keys, seed, F.col(value).alias(name))
    return side(a, "x").join(side(b, "y"), ["adapter", *keys, seed]).select("adapter", *keys, seed, (F.col("x") - F.col("y")).alias("d"))


def seed_difference_summary(differences: DataFrame, keys: list[str], seed: str = "seed") -> DataFrame:
    """n_seeds, mean_diff, sd (null for one) and the list of differences as text."""
    said = F.transform(F.array_sort(F.collect_list(F.struct(seed, "d"))), lambda x: F.concat(F.lit("s"), x[seed].cast("string"), F.lit("="), fixed(x["d"], 4, plus=True)))
    return differences.groupBy("adapter", *keys).agg(F.count("*").alias("n_seeds"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"), F.array_join(said, "; ").alias("per_seed"))


def dimension_means(values: DataFrame, by: list[str]) -> DataFrame:
    """Mean and number of items of each numeric dimension; values(by, metric, value) of unpivoted score records."""
    return values.groupBy(*by, F.col("metric").alias("dimension")).agg(F.avg("value").alias("value"), F.count("value").alias("n_items"))


def merge_judge_scores(metrics: DataFrame, judged: DataFrame, keys: tuple[str, ...] = ("model", "task", "n_shot")) -> DataFrame:
    """All metric cells, with the judge's scores where it has the cell."""
    return metrics.join(judged, list(keys), "left")


def recheck_shield(train: DataFrame, test_index: DataFrame, *, sample: int = 500, seed: int = 42, id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """sampled, leaks of a seeded sample of rows that passed the shield: leaks must be 0."""
    some = stored(take_first(train, shuffled(seed, id_col), sample), "shield-sample")  # read twice below: without this the whole shield would run again
    return some.agg(F.count("*").alias("sampled")).join(F.broadcast(leakage_filter(some, test_index, threshold, id_col=id_col).agg(F.count("*").alias("clean")))).select("sampled", (F.col("sampled") - F.col("clean")).alias("leaks"))  # one row each


def reproportion(candidates: DataFrame, name: str, share: float, least: int = 50, *, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """candidates with `split`: in seeded order the first max(least, share) keep the split `name`, the rest go to train."""
    keep = max(least, int(candidates.count() * share))
    rows = numbered(candidates, [*shuffled(seed, id_col)])
    return rows.withColumn("split", F.when(F.col("pos") < keep, name).otherwise("train")).drop("pos")


def loss_summary(runs: DataFrame, columns: tuple[str, ...] = ("task", "n_train", "n_val", "n_epochs", "train_loss")) -> DataFrame:
    return runs.select(*columns)


def dz_table(stats: DataFrame, shots: list[int], p: str = "p") -> DataFrame:
    """model and one column for each shot: dz with its sign, three digits and stars."""
    cell = F.concat(fixed("dz", 3, plus=True), S.stars(p))
    return stats.withColumn("cell", cell).groupBy("model").pivot("n_shot", shots).agg(F.first("cell"))


def forgetting_probe(scored: DataFrame, *by: str, ppl: str = "ppl") -> DataFrame:
    """The geometric mean of perplexities, each at least 1e-6."""
    return scored.groupBy(*by).agg(F.exp(F.avg(F.log(F.greatest(F.col(ppl), F.lit(1e-6))))).alias("probe"))


def forgetting_delta(before: DataFrame, after: DataFrame, by: list[str], most: float = 5.0) -> DataFrame:
    """before, after, delta and whether it is below `most`."""
    both = before.withColumnRenamed("probe", "before").join(after.withColumnRenamed("probe", "after"), by)
    return both.withColumn("delta", F.col("after") - F.col("before")).withColumn("ok", F.col("delta") < most)


def perplexity_of_loss(loss: Column | str) -> Column:
    return F.when(col(loss) < 20, libm.exp(F.least(col(loss), F.lit(20.0)))).otherwise(F.lit(float("inf")))


def shot_shift(task_means: DataFrame, low: int = 0, high: int = 5, value: str = "score") -> DataFrame:
    """Means over the tasks that both shots have (two at least), their difference, and Wilcoxon's p; a model has few tasks."""
    side = lambda shot, name: task_means.filter(F.col("n_shot") == shot).select("model", "task", F.col(value).alias(name))
    both = side(low, "x").join(side(high, "y"), ["model", "task"]).withColumn("d", F.col("x") - F.col("y"))
    out = both.groupBy("model").agg(F.count("*").alias("n_tasks"), F.avg("x").alias("mean_low"), F.avg("y").alias("mean_high"), F.collect_list("d").alias("__d")).filter("n_tasks >= 2")
    return out.select("model", "n_tasks", "mean_low", "mean_high", (F.col("mean_high") - F.col("mean_low")).alias("delta"), dist.wilcoxon_udf("__d").alias("p"))


def normal_interval(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n, means, delta, its interval of 1.96 standard errors, t and d of paired items."""
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.avg("r").alias("mean_r"), F.avg("d").alias("delta"), F.stddev_samp("d").alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return out.withColumns({"ci_lo": F.col("delta") - 1.96 * se, "ci_hi": F.col("delta") + 1.96 * se, "t": F.when(se > 0, F.col("delta") / se), "cohens_d": F.col("delta") / (F.col("sd") + 1e-12)}).drop("sd")


def cell_mean_test(cells: DataFrame, reference: str, sizes: dict[str, int]) -> DataFrame:
    """Approximate tests from cell means alone, marked `synthetic`: cells(model, task, n_shot, score), the items of each task, assumed item deviations."""
    ref = cells.filter(F.col("model") == reference).select("task", "n_shot", F.col("score").alias("mean_r"))
    n = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(v))])[F.col("task")]
    out = cells.filter(F.col("model") != reference).withColumnRenamed("score", "mean_x").join(ref, ["task", "n_shot"]).withColumns({"n": n, "delta": F.col("mean_x") - F.col("mean_r"), "sd": F.when(F.col("task") == "absqa", ITEM_SD_ABSQA).otherwise(ITEM_SD)})
    se = F.col("sd") * F.sqrt(2 / F.col("n"))
    out = out.withColumns({"ci_lo": F.col("delta") - 1.96 * se, "ci_hi": F.col("delta") + 1.96 * se, "t": F.col("delta") / se, "cohens_d": F.col("delta") / F.col("sd"), "synthetic": F.lit(True)})
    return out.withColumn("p", dist.t_two_sided_udf("t", (F.col("n") - 1).cast("double"))).drop("sd")


def judge_inputs(rows: DataFrame, *, pairwise: bool = False) -> DataFrame:
    """The parts of a prompt cut to what a judge reads: question 500, reference and answer 1500; in duels 1200 and 1400."""
    cuts = {"question": 500, "reference": 1200 if pairwise else 1500, "answer": 1400 if pairwise else 1500, "other": 1400}
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in cuts.items() if c in rows.columns})
