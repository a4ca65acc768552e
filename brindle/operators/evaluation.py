"""Scores of predictions per cell (model, task, shots) and tables built from cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.metrics import bleu4, exact_match, hamming, rouge_l, set_accuracy, token_f1
from brindle.functions.text import classify_failure

CELL = ("model", "n_shot")
ERRORS = ("correct", "partial_match", "under_predict", "over_predict", "all_wrong", "format_failure", "empty_generation")


def score_mcqa(items: DataFrame, by: tuple[str, ...] = CELL, *, pred: str = "pred", gold: str = "gold", n_choices: str = "n_choices") -> DataFrame:
    """accuracy, hamming and macro_f1 (over the letters that occur, up to the largest n_choices of the cell) and n of each cell."""
    own = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: x != "")))
    rows = items.select(*by, F.coalesce(F.col(pred), F.lit("")).alias("p_s"), F.coalesce(F.col(gold), F.lit("")).alias("g_s"), own(pred).alias("p"), own(gold).alias("g"), F.col(n_choices).alias("n"))
    base = rows.groupBy(*by).agg(F.avg(set_accuracy("p_s", "g_s")).alias("accuracy"), F.avg(hamming(F.col("p"), F.col("g"), F.col("n"))).alias("hamming"), F.count("*").alias("n"), F.max("n").alias("__most"))
    letters = rows.select(*by, "p", "g", F.explode(F.array_union("p", "g")).alias("letter"))
    has = lambda c: F.array_contains(F.col(c), F.col("letter"))
    counts = letters.groupBy(*by, "letter").agg(F.count_if(has("p") & has("g")).alias("tp"), F.count_if(has("p") & ~has("g")).alias("fp"), F.count_if(~has("p") & has("g")).alias("fn"))
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    macro = counts.join(base.select(*by, "__most"), list(by)).filter(F.ascii("letter") - 65 < F.col("__most")).groupBy(*by).agg(F.avg(f1).alias("macro_f1"))
    return base.drop("__most").join(macro, list(by), "left").fillna(0.0, ["macro_f1"])


def score_extqa(items: DataFrame, by: tuple[str, ...] = CELL, *, pred: str = "pred", gold: str = "gold") -> DataFrame:
    return items.groupBy(*by).agg(F.avg(exact_match(pred, gold)).alias("em"), F.avg(token_f1(pred, gold)).alias("token_f1"), F.count("*").alias("n"))


def score_absqa(items: DataFrame, by: tuple[str, ...] = CELL, *, pred: str = "pred", gold: str = "gold", bert_f1: str | None = None) -> DataFrame:
    """rouge_l, bleu4 and, from an input column, bertscore_f1 of each cell."""
    scored = items.withColumns({"__r": rouge_l(pred, gold), "__b": bleu4(pred, gold)})
    bert = F.avg(bert_f1) if bert_f1 else F.lit(None).cast("double")
    return scored.groupBy(*by).agg(F.avg("__r").alias("rouge_l"), F.avg("__b").alias("bleu4"), bert.alias("bertscore_f1"), F.count("*").alias("n"))


def rescored(items: DataFrame, by: tuple[str, ...] = CELL) -> DataFrame:
    """The cells with at least one judged answer, scored again with the judged answers where there are any."""
    touched = items.filter(F.coalesce(F.col("route"), F.lit("")) == "judge").select(*by).distinct()
    return score_mcqa(items.join(touched, list(by), "left_semi").withColumn("pred", F.coalesce(F.nullif("pred_judged", F.lit("")), "pred")), by)


def error_fractions(items: DataFrame, by: tuple[str, ...] = CELL, *, pred: Column, gold: Column, cleaned: str) -> DataFrame:
    """The share of each error class in each cell; all classes are columns."""
    classes = items.select(*by, classify_failure(pred, gold, cleaned).alias("c"))
    return classes.groupBy(*by).agg(*[(F.count_if(F.col("c") == e) / F.count("*")).alias(e) for e in ERRORS], F.count("*").alias("n"))


def calibration_error(items: DataFrame, by: tuple[str, ...], *, correct: Column, confidence: Column | None = None, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins; without confidences they are 1."""
    conf = F.lit(1.0) if confidence is None else confidence
    rows = items.select(*by, conf.alias("c"), correct.cast("double").alias("ok")).withColumn("bin", F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)))
    per = rows.groupBy(*by, "bin").agg(F.count("*").alias("k"), F.avg("ok").alias("acc"), F.avg("c").alias("conf"))
    return per.groupBy(*by).agg((F.sum(F.col("k") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("k")).alias("ece"))


def pivot_mean(cells: DataFrame, index: str, columns: list[str], value: str, names: list[str], digits: int = 4) -> DataFrame:
    """index x named columns, mean of value; the names are given, so no extra pass finds them."""
    key = F.concat_ws("_", *columns)
    out = cells.groupBy(index).pivot("__key", names) if "__key" in cells.columns else cells.withColumn("__key", key).groupBy(index).pivot("__key", names)
    return out.agg(F.round(F.avg(value), digits))


def delta_to(cells: DataFrame, reference: str, keys: list[str], value: str, name: str = "model") -> DataFrame:
    """Each cell's difference to the reference model's cell, absolute and in per cent."""
    ref = cells.filter(F.col(name) == reference).select(*keys, F.col(value).alias("__ref"))
    diff = F.col(value) - F.col("__ref")
    return cells.filter(F.col(name) != reference).join(ref, keys).select(name, *keys, value, diff.alias("delta"), (F.try_divide(diff, F.col("__ref")) * 100).alias("pct"))


def spread(cells: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, sample sd (0 for one), least, greatest, range and coefficient of variation in per cent."""
    mean, sd = F.avg(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return cells.groupBy(*by).agg(mean.alias("mean"), sd.alias("sd"), F.min(value).alias("least"), F.max(value).alias("greatest"), (F.max(value) - F.min(value)).alias("range"), (F.try_divide(sd, mean) * 100).alias("cv"))


def best_per(cells: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """The row of the greatest value of each group; ties go to the first `tie`."""
    return cells.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie))).filter("__r = 1").drop("__r")


def missing_cells(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells still to compute: not there, or there without a valid item."""
    good = done.filter(~((F.col("n_valid") == 0) & (F.col("n_total") > 0)))
    return wanted.join(good.select(*keys).distinct(), keys, "left_anti")


def first_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the first in order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("__r = 1").drop("__r")
