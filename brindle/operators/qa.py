"""QA data: schema unification, entity spans to extractive questions, validation, statistics, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import col, hash_text

QA_FIELDS = ("id", "task", "question", "context", "options", "answer", "answer_meta", "specialty", "source")
QA_SCHEMA = "id string, task string, question string, context string, options map<string,string>, answer string, answer_meta struct<raw_correct: string, answer_start: bigint, short_answer: string, long_answer: string>, specialty string, source string"
# The question asked for each entity type.
QUESTIONS = {
    "ANAT": "Quelle structure anatomique est mentionnée ?", "CHEM": "Quel composé chimique ou médicament est mentionné ?", "DEVI": "Quel dispositif médical est mentionné ?",
    "DISO": "Quelle pathologie ou trouble est mentionné ?", "GEOG": "Quel lieu géographique est mentionné ?", "LIVB": "Quel organisme vivant est mentionné ?",
    "OBJC": "Quel objet est mentionné ?", "PHEN": "Quel phénomène biologique est mentionné ?", "PHYS": "Quel processus physiologique est mentionné ?", "PROC": "Quelle procédure médicale est mentionnée ?",
}


def _meta(**given: Column) -> Column:
    kinds = {"raw_correct": "string", "answer_start": "bigint", "short_answer": "string", "long_answer": "string"}
    return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def falsy(*columns: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in columns])


def _has(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that is neither null nor empty; columns that are not there are passed over."""
    return falsy(*[F.col(n) for n in names if n in df.columns], F.lit(None))


def normalise_mcqa(rows: DataFrame, source: str) -> DataFrame:
    """id, question, answers (map), correct_answers (string or list) to the QA schema."""
    kind = dict(rows.dtypes)["correct_answers"]
    raw = F.upper(F.array_join("correct_answers", "") if kind.startswith("array") else F.col("correct_answers"))
    answer = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(raw, ""), lambda x: x.rlike("^[A-Z]$")))), ",")
    return rows.select(
        F.coalesce(_has(rows, "id"), hash_text("question")).alias("id"), F.lit("mcqa").alias("task"), "question", F.lit(None).cast("string").alias("context"), F.col("answers").alias("options"),
        answer.alias("answer"), _meta(raw_correct=raw).alias("answer_meta"), _has(rows, "subject", "specialty").alias("specialty"), F.lit(source).alias("source"),
    )


def normalise_extqa(rows: DataFrame) -> DataFrame:
    """id, question, context, answers struct(text, answer_start lists) to the QA schema."""
    return rows.select(
        F.coalesce(_has(rows, "id"), hash_text("question")).alias("id"), F.lit("extqa").alias("task"), "question", "context", F.lit(None).cast("map<string,string>").alias("options"),
        F.coalesce(F.try_element_at("answers.text", F.lit(1)), F.lit("")).alias("answer"), _meta(answer_start=F.try_element_at("answers.answer_start", F.lit(1))).alias("answer_meta"),
        _has(rows, "specialty").alias("specialty"), F.coalesce(_has(rows, "source"), F.lit("extqa")).alias("source"),
    )


def normalise_absqa(rows: DataFrame, source: str) -> DataFrame:
    return rows.select(
        F.coalesce(_has(rows, "id", "question_id"), hash_text("question")).alias("id"), F.lit("absqa").alias("task"), "question", _has(rows, "context").alias("context"), F.lit(None).cast("map<string,string>").alias("options"),
        F.coalesce(_has(rows, "long_answer", "answer", "short_answer"), F.lit("")).alias("answer"), _meta(short_answer=_has(rows, "short_answer"), long_answer=_has(rows, "long_answer")).alias("answer_meta"),
        _has(rows, "specialty", "speciality").alias("specialty"), F.lit(source).alias("source"),
    )


def entity_spans(sentences: DataFrame, *, id_col: str = "sent_id", tokens_col: str = "tokens", tags_col: str = "tags") -> DataFrame:
    """id, kind, first, last (0-based tokens), answer, start (character offset), context of each entity of BIO tags.

    B-X opens a span that following tags I-X extend; sentences whose lists differ in length give none.
    """
    ok = sentences.filter(F.size(tokens_col) == F.size(tags_col)).select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"), F.col(tags_col).alias("tags"))
    opens = ok.select("*", F.posexplode("tags").alias("first", "tag")).filter(F.col("tag").startswith("B-")).withColumn("kind", F.substring("tag", 3, 100))
    # the place of the first later tag that does not extend the span
    later = F.filter(F.sequence(F.col("first") + 1, F.size("tags")), lambda i: (i >= F.size("tags")) | ~F.coalesce(F.try_element_at(F.col("tags"), (i + 1).cast("int")), F.lit("")).startswith(F.concat(F.lit("I-"), F.col("kind"))))
    spans = opens.withColumn("last", F.array_min(later) - 1)
    before = F.slice("tokens", F.lit(1), F.col("first"))
    start = F.aggregate(before, F.lit(0), lambda s, t: s + F.length(t) + 1)
    answer = F.array_join(F.slice("tokens", F.col("first") + 1, F.col("last") - F.col("first") + 1), " ")
    return spans.select("id", "kind", "first", "last", answer.alias("answer"), start.alias("start"), F.array_join("tokens", " ").alias("context"))


def spans_to_extqa(spans: DataFrame, label: str, cap: int | None = None) -> DataFrame:
    """QA rows of entity spans; a cap ends at the sentence that reaches it, which stays whole."""
    if cap is not None:
        per = spans.groupBy("id").agg(F.count("*").alias("__n"))
        from brindle.operators.order import running

        ok = running(per, [F.col("id")], {"__before": F.col("__n")}).filter(F.col("__before") < cap).select("id")
        spans = spans.join(ok, "id", "left_semi")
    ask = F.create_map(*[F.lit(x) for kv in QUESTIONS.items() for x in kv])
    question = F.coalesce(F.try_element_at(ask, F.col("kind")), F.concat(F.lit("Quelle entité de type "), F.col("kind"), F.lit(" est mentionnée ?")))
    return spans.select(
        F.concat_ws("_", F.lit(label), "id", "first").alias("id"), F.lit("extqa").alias("task"), question.alias("question"), "context", F.lit(None).cast("map<string,string>").alias("options"),
        "answer", _meta(answer_start=F.col("start")).alias("answer_meta"), F.lit(None).cast("string").alias("specialty"), F.lit(label).alias("source"),
    )


def violations(rows: DataFrame, *, need_context: bool = True) -> DataFrame:
    """id, rule, hard of each broken rule of the QA schema."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", " ")
    inside = F.contains(F.col("context"), F.col("answer")) | F.contains(squeeze("context"), squeeze("answer"))
    rules = [
        ("id", True, blank("id")), ("task", True, ~F.coalesce(F.col("task").isin("mcqa", "extqa", "absqa"), F.lit(False))), ("question", True, blank("question")), ("answer", True, blank("answer")),
        ("letters", True, (F.col("task") == "mcqa") & ~F.coalesce(F.col("answer"), F.lit("")).rlike(r"^[A-Z](,[A-Z])*$")), ("context", True, (F.col("task") == "extqa") & blank("context") & F.lit(need_context)),
        ("span", False, (F.col("task") == "extqa") & ~blank("context") & ~F.coalesce(inside, F.lit(False))),
    ]
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(h).alias("hard"))) for r, h, c in rules]), lambda x: x.isNotNull())
    return rows.select("id", F.explode(broken).alias("v")).select("id", "v.rule", "v.hard")


def fingerprint(task: Column | str, question: Column | str, options: Column | str, answer: Column | str) -> Column:
    """The text that the shield compares: question and options, question and answer, or the question alone."""
    values = F.array_join(F.map_values(col(options)), " ")
    return F.when(col(task) == "mcqa", F.concat_ws(" ", col(question), values)).when(col(task) == "extqa", F.concat_ws(" ", col(question), col(answer))).otherwise(col(question))


def task_stats(rows: DataFrame, by: list[str], words: Column, speciality: str) -> DataFrame:
    """n, mean, median and 95th percentile of words, and distinct specialties of each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(words).alias("mean"), F.percentile(words, F.lit(0.5)).alias("median"), F.percentile(words, F.lit(0.95)).alias("p95"), F.count_distinct(speciality).alias("n_specialties"))


def most_common(rows: DataFrame, by: list[str], value: str, k: int, first: str) -> DataFrame:
    """The k most frequent values of each group, ties by first appearance in the order of `first`."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(first).alias("__first"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "__first", value))).filter(F.col("rank") <= k).drop("__first")


def task_summary(rows: DataFrame, by: list[str], words: Column, speciality: str, answer: str, first: str) -> DataFrame:
    """task_stats with top5_specialties and answer_distribution_top5: arrays of (value, n), most frequent first, of the specialties that are there and of the answers' first 30 characters."""
    key = list(by)

    def top(values: DataFrame, name: str) -> DataFrame:
        best = most_common(values, key, "__value", 5, first)
        entries = F.array_sort(F.collect_list(F.struct("rank", F.col("__value").alias("value"), "n")))  # five at most
        return best.groupBy(*key).agg(F.transform(entries, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(name))

    present = rows.withColumn("__value", F.col(speciality)).filter(F.coalesce(F.col("__value"), F.lit("")) != "")
    answers = rows.withColumn("__value", F.substring(F.coalesce(F.col(answer).cast("string"), F.lit("None")), 1, 30))
    out = task_stats(rows.withColumn(speciality, F.nullif(F.col(speciality), F.lit(""))), by, words, speciality)
    return out.join(top(present, "top5_specialties"), key, "left").join(top(answers, "answer_distribution_top5"), key, "left")
