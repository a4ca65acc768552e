"""Queries of the registry, seed and report operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.functions.libm import scaled_round
from brindle.operators import judging as J
from brindle.operators import near_dup as N
from brindle.operators import reports as R
from brindle.operators import stats as S
from brindle.plans import corpus_queries as C
from brindle.plans import eval_queries as V
from brindle.plans import stats_sql as Z
from brindle.plans.tables import CELL_SCORES_SQL, SCORES_SQL, cell_scores, scores, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Events as models of two families with task suffixes, on three seeds.
_SUFFIX = "CASE user_id % 6 WHEN 0 THEN 'DAPT' WHEN 1 THEN 'MCQA' WHEN 2 THEN 'ExtQA' WHEN 3 THEN 'AbsQA' WHEN 4 THEN 'Unified' ELSE 'Other' END"
_MODEL = f"concat(CASE WHEN event_id % 2 = 0 THEN 'Perplexity-' ELSE 'NoPPL-' END, {_SUFFIX})"
_SEEDED = f"SELECT CAST(42 + event_id % 3 AS INT) AS seed, {_MODEL} AS model, event_type AS metric, avg(value) AS value FROM events GROUP BY 1, 2, 3"
_KNOWN = "nullif(regexp_extract({0}, '-(DAPT|MCQA|ExtQA|AbsQA|Unified)$', 1), '')"


def _seeded(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("CAST(42 + event_id % 3 AS INT) AS seed", f"{_MODEL} AS model", "event_type AS metric", "value")
    return e.groupBy("seed", "model", "metric").agg(F.avg("value").alias("value"))


@query("task_suffixes", f"SELECT event_id, {_KNOWN.format(_MODEL)} AS suffix FROM events")
def task_suffixes(spark, sf_dir):
    """T32."""
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_MODEL} AS m").select("event_id", R.task_suffix("m").alias("suffix"))


@query("current_referees", f"SELECT judge, count(*) AS n FROM ({SCORES_SQL}) WHERE judge IN ('j0', 'j7') GROUP BY 1")
def current_referees(spark, sf_dir):
    """S19."""
    registry = spark.createDataFrame([("j0",), ("j7",)], "judge string")
    return R.current_referees(scores(spark, sf_dir), registry).groupBy("judge").agg(F.count("*").alias("n"))


@query("human_times", "SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60) ELSE printf('%.2fh', s / 3600) END AS t, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM (SELECT event_id, ts, CAST(event_id * 7 % 9000 AS DOUBLE) + 0.26 AS s FROM events)")
def human_times(spark, sf_dir):
    """T34."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "ts", "CAST(event_id * 7 % 9000 AS DOUBLE) + CAST(0.26 AS DOUBLE) AS s")
    return e.select("event_id", R.human_time("s").alias("t"), R.stamp("ts").alias("stamp"))


_QA = ("normalise_mcqa", "normalise_extqa", "normalise_absqa")


@query("task_union", " UNION ALL ".join(f"SELECT task, id, question, answer FROM ({V.ORACLES[q]})" for q in _QA))
def task_union(spark, sf_dir):
    """G6."""
    parts = [V.QUERIES[q](spark, sf_dir).select("task", "id", "question", "answer") for q in _QA]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("target_texts", f"SELECT conv_id, turn, md5(t) AS text_md5 FROM (SELECT conv_id, turn, {C.CLEAN.format('j')} AS t FROM (SELECT conv_id, turn, concat_ws(' ', role, nullif(text, ''), CASE WHEN turn % 2 = 0 THEN 'x' END) AS j FROM conversations)) WHERE t != ''")
def target_texts(spark, sf_dir):
    """The parts of a row joined, nulls left out."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role AS question", "nullif(text, '') AS context", "CASE WHEN turn % 2 = 0 THEN 'x' END AS answer")
    return R.target_texts(rows, "question", "context", "answer").select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query("qa_fingerprints", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN concat_ws(' ', p_name, p_brand, p_type) WHEN 1 THEN concat_ws(' ', p_name, p_type) ELSE p_name END AS fp FROM part")
def qa_fingerprints(spark, sf_dir):
    """Question and options, question and answer, or the question; options come as a list."""
    from brindle.operators import qa as Q

    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_size % 3 WHEN 0 THEN 'mcqa' WHEN 1 THEN 'extqa' ELSE 'absqa' END AS task", "p_name", "p_type", "array(p_brand, p_type) AS o")
    return rows.select("p_partkey", Q.fingerprint("task", "p_name", X.options_from_list("o"), "p_type").alias("fp"))


@query("shield_recheck", f"SELECT least(500, count(*)) AS sampled, count(*) FILTER (WHERE doc_id IN ({C._HIT})) AS leaks FROM documents WHERE doc_id NOT IN ({C._HIT})")
def shield_recheck(spark, sf_dir):
    """J9."""
    index = N.lsh_index(table(spark, sf_dir, "benchmark"), 0.80, id_col="item_id")
    return R.recheck_shield(N.leakage_filter(C.docs(spark, sf_dir), index), index)


@query("judge_score_merge", f"WITH m AS (SELECT model, n_shot, avg(item) AS value FROM ({SCORES_SQL}) GROUP BY 1, 2), j AS (SELECT model, n_shot, avg(score) AS judged FROM ({SCORES_SQL}) WHERE n_shot > 0 GROUP BY 1, 2) SELECT model, 'absqa' AS task, n_shot, round(value, 6) AS value, round(judged, 6) AS judged FROM m LEFT JOIN j USING (model, n_shot)")
def judge_score_merge(spark, sf_dir):
    """J10."""
    s = scores(spark, sf_dir).withColumn("task", F.lit("absqa"))
    metrics = s.groupBy("model", "task", "n_shot").agg(F.avg("item").alias("value"))
    return r6(R.merge_judge_scores(metrics, s.filter("n_shot > 0").groupBy("model", "task", "n_shot").agg(F.avg("score").alias("judged"))), "value", "judged")


_DIFF = f"WITH m AS ({_SEEDED}), x AS (SELECT *, {_KNOWN.format('model')} AS adapter FROM m), d AS (SELECT a.adapter, a.metric, a.seed, a.value - b.value AS d FROM x a JOIN x b ON a.adapter = b.adapter AND a.metric = b.metric AND a.seed = b.seed WHERE starts_with(a.model, 'Perplexity-') AND starts_with(b.model, 'NoPPL-'))"


@query("seed_differences", _DIFF + " SELECT adapter, metric, seed, round(d, 6) AS d FROM d")
def seed_differences(spark, sf_dir):
    """J14."""
    return r6(R.seed_differences(_seeded(spark, sf_dir), "Perplexity", "NoPPL", ["metric"]), "d")


@query("seed_difference_summary", _DIFF + " SELECT adapter, metric, count(*) AS n_seeds, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS sd, string_agg(printf('s%d=%+.4f', seed, d), '; ' ORDER BY seed) AS per_seed FROM d GROUP BY 1, 2")
def seed_difference_summary(spark, sf_dir):
    """H25."""
    return r6(R.seed_difference_summary(R.seed_differences(_seeded(spark, sf_dir), "Perplexity", "NoPPL", ["metric"]), ["metric"]), "mean_diff", "sd")


_NAMES = f"SELECT DISTINCT {_MODEL} AS m FROM events UNION SELECT 'Vanilla'"


@query("matchups", f"WITH n AS ({_NAMES}), p AS (SELECT m, {_KNOWN.format('m')} AS s FROM n WHERE starts_with(m, 'Perplexity')), q AS (SELECT m, {_KNOWN.format('m')} AS s FROM n WHERE starts_with(m, 'NoPPL')) SELECT m AS challenger, 'Vanilla' AS opponent, 'A_PPL_vs_Vanilla' AS axis FROM p UNION ALL SELECT m, 'Vanilla', 'B_NoPPL_vs_Vanilla' FROM q UNION ALL SELECT p.m, q.m, 'C_PPL_vs_NoPPL' FROM p JOIN q USING (s)")
def matchups(spark, sf_dir):
    """J16."""
    names = table(spark, sf_dir, "events").selectExpr(f"{_MODEL} AS model").unionByName(spark.createDataFrame([("Vanilla",)], "model string"))
    return R.matchups(names, "Perplexity", "NoPPL", "Vanilla")


@query("reproportion", f"WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY {C.U32.format(chr(39) + '42|' + chr(39) + ' || doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents WHERE lang = 'en') SELECT doc_id, CASE WHEN r <= greatest(50, CAST(floor(n * 0.05) AS BIGINT)) THEN 'test' ELSE 'train' END AS split FROM r")
def reproportion(spark, sf_dir):
    """P2's test side."""
    return R.reproportion(C.docs(spark, sf_dir).filter("lang = 'en'").select("doc_id"), "test", 0.05)


@query("judge_means_by_seed", "SELECT CAST(42 + event_id % 3 AS INT) AS seed, event_type AS model, dimension, round(avg(v), 6) AS value, count(v) AS n_items FROM (SELECT event_id, event_type, value, CAST(user_id AS DOUBLE) AS user_id FROM events) UNPIVOT (v FOR dimension IN (value, user_id)) WHERE event_type != 'view' OR event_id % 3 = 0 GROUP BY 1, 2, 3")
def judge_means_by_seed(spark, sf_dir):
    """A28 with A27: every numeric dimension, the vanilla model on the first seed only."""
    e = table(spark, sf_dir, "events").selectExpr("CAST(42 + event_id % 3 AS INT) AS seed", "event_type AS model", "value", "user_id")
    leaves = J.unpivot_numbers(J.once_per_seed(e, "view"), ["seed", "model"])
    return r6(R.dimension_means(leaves, ["seed", "model"]), "value")


@query("loss_summary", "SELECT event_type AS task, count(*) FILTER (WHERE event_id % 10 < 9) AS n_train, count(*) FILTER (WHERE event_id % 10 = 9) AS n_val, 3 AS n_epochs, round(avg(value), 6) AS train_loss FROM events GROUP BY 1")
def loss_summary(spark, sf_dir):
    """A34."""
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(F.count_if(F.expr("event_id % 10 < 9")).alias("n_train"), F.count_if(F.expr("event_id % 10 = 9")).alias("n_val"), F.lit(3).alias("n_epochs"), F.avg("value").alias("train_loss"))
    return r6(R.loss_summary(runs), "train_loss")


_CELL = "printf('%+.3f', dz) || CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END"


@query("dz_table", V._STATS + f", y AS (SELECT model, n_shot, {_CELL} AS c FROM (SELECT *, (n * 7919 % 97) / 970.0 AS p FROM e)) SELECT model, max(c) FILTER (WHERE n_shot = 0) AS \"0\", max(c) FILTER (WHERE n_shot = 3) AS \"3\", max(c) FILTER (WHERE n_shot = 5) AS \"5\" FROM y GROUP BY 1")
def dz_table(spark, sf_dir):
    """A35."""
    stats = S.paired_stats(V._pairs(spark, sf_dir), ["model", "n_shot"]).withColumn("p", F.col("n") * 7919 % 97 / 970.0)
    return R.dz_table(stats, [0, 3, 5])


@query("forgetting", "WITH b AS (SELECT event_type AS model, exp(avg(ln(greatest(value, 1e-6)))) AS before, exp(avg(ln(greatest(value * 1.01 + user_id % 3, 1e-6)))) AS after FROM events GROUP BY 1) SELECT model, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta, after - before < 5 AS ok FROM b")
def forgetting(spark, sf_dir):
    """M10, M11."""
    e = table(spark, sf_dir, "events").selectExpr("event_type AS model", "value AS ppl", "value * CAST(1.01 AS DOUBLE) + user_id % 3 AS later")
    return r6(R.forgetting_delta(R.forgetting_probe(e, "model"), R.forgetting_probe(e, "model", ppl="later"), ["model"]), "before", "after", "delta")


@query("loss_perplexity", "SELECT event_id, CASE WHEN value / 10 < 20 THEN round(exp(value / 10), 4) ELSE CAST('inf' AS DOUBLE) END AS ppl FROM events")
def loss_perplexity(spark, sf_dir):
    """M12."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "value / 10 AS loss").select("event_id", scaled_round(R.perplexity_of_loss("loss"), 4).alias("ppl"))


@query("shot_shift", f"WITH t AS (SELECT model, axis AS task, n_shot, avg(score) AS s FROM ({SCORES_SQL}) GROUP BY 1, 2, 3), d AS (SELECT a.model, a.task, a.s AS x, b.s AS y FROM t a JOIN t b ON a.model = b.model AND a.task = b.task AND a.n_shot = 0 AND b.n_shot = 5) SELECT model, count(*) AS n_tasks, round(avg(x), 6) AS mean_low, round(avg(y), 6) AS mean_high, round(avg(y) - avg(x), 6) AS delta FROM d GROUP BY 1 HAVING count(*) >= 2")
def shot_shift(spark, sf_dir):
    """H7's means and difference."""
    means = scores(spark, sf_dir).groupBy("model", F.col("axis").alias("task"), "n_shot").agg(F.avg("score").alias("score"))
    return r6(R.shot_shift(means).drop("p"), "mean_low", "mean_high", "delta")


@query("normal_intervals", V._PAIRS + ", s AS (SELECT model, n_shot, count(*) AS n, avg(x) AS mean_x, avg(r) AS mean_r, avg(d) AS delta, stddev_samp(d) AS sd FROM p GROUP BY 1, 2) SELECT model, n_shot, n, round(mean_x, 6) AS mean_x, round(mean_r, 6) AS mean_r, round(delta, 6) AS delta, round(delta - 1.96 * sd / sqrt(n), 6) AS ci_lo, round(delta + 1.96 * sd / sqrt(n), 6) AS ci_hi, CASE WHEN sd > 0 THEN round(delta / (sd / sqrt(n)), 6) END AS t, round(delta / (sd + 1e-12), 6) AS cohens_d FROM s")
def normal_intervals(spark, sf_dir):
    """H18."""
    return r6(R.normal_interval(V._pairs(spark, sf_dir), ["model", "n_shot"]), "mean_x", "mean_r", "delta", "ci_lo", "ci_hi", "t", "cohens_d")


_SIZES = {"mcqa": 622, "extqa": 207, "absqa": 247}


@query("cell_mean_tests", f"WITH c AS (SELECT model, t.task, t.n, n_shot, avg(score) * t.f AS score FROM ({CELL_SCORES_SQL}), (VALUES ('mcqa', 622, 1.0), ('extqa', 207, 1.1), ('absqa', 247, 1.3)) t(task, n, f) GROUP BY 1, 2, 3, 4, t.f), d AS (SELECT a.model, a.task, a.n_shot, a.n, a.score AS mean_x, r.score AS mean_r, a.score - r.score AS delta, CASE a.task WHEN 'absqa' THEN 0.9 ELSE 0.45 END AS sd FROM c a JOIN c r ON a.task = r.task AND a.n_shot = r.n_shot AND r.model = 'view' WHERE a.model != 'view') SELECT model, task, n_shot, n, round(mean_x, 6) AS mean_x, round(mean_r, 6) AS mean_r, round(delta, 6) AS delta, round(delta - 1.96 * sd * sqrt(2.0 / n), 6) AS ci_lo, round(delta + 1.96 * sd * sqrt(2.0 / n), 6) AS ci_hi, round(delta / (sd * sqrt(2.0 / n)), 6) AS t, round(delta / sd, 6) AS cohens_d, true AS synthetic FROM d")
def cell_mean_tests(spark, sf_dir):
    """H19 but for its p."""
    tasks = spark.createDataFrame([("mcqa", 1.0), ("extqa", 1.1), ("absqa", 1.3)], "task string, f double")
    cells = cell_scores(spark, sf_dir).groupBy("model", "n_shot").agg(F.avg("score").alias("s")).join(F.broadcast(tasks)).select("model", "task", "n_shot", (F.col("s") * F.col("f")).alias("score"))  # three rows
    return r6(R.cell_mean_test(cells, "view", _SIZES).drop("p"), "mean_x", "mean_r", "delta", "ci_lo", "ci_hi", "t", "cohens_d")


@query("judge_inputs", "SELECT doc_id, md5(substr(text, 1, 500)) AS q, md5(substr(text, 1, 1500)) AS r, md5(substr(text, 1, 1200)) AS pr, md5(substr(text, 1, 1400)) AS pa FROM documents")
def judge_inputs(spark, sf_dir):
    """The cuts of both prompts."""
    d = C.docs(spark, sf_dir).selectExpr("doc_id", "text AS question", "text AS reference", "text AS answer", "text AS other")
    one, two = R.judge_inputs(d), R.judge_inputs(d, pairwise=True)
    return one.select("doc_id", F.md5("question").alias("q"), F.md5("reference").alias("r")).join(two.select("doc_id", F.md5("reference").alias("pr"), F.md5("answer").alias("pa")), "doc_id")


@query("verdict_reasons", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'B est faux' WHEN 1 THEN 'deux ' || chr(10) || 'lignes' ELSE '' END AS reason FROM events")
def verdict_reasons(spark, sf_dir):
    """T28's reason."""
    said = "CASE event_id % 3 WHEN 0 THEN '{\"winner\": \"A\", \"Reason\": \" B est faux \"}' WHEN 1 THEN concat('reason = \"deux ', chr(10), 'lignes\", winner: B') ELSE 'A' END AS t"
    return table(spark, sf_dir, "events").selectExpr("event_id", said).select("event_id", X.verdict_reason("t").alias("reason"))


@query("rubric_aliases", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (1 + event_id % 5 + 4 + 3 + 2) / 4.0 END AS composite FROM events")
def rubric_aliases(spark, sf_dir):
    """Axes under their other names, scores such as 4/5 and 3.7, and scores out of range."""
    said = "CASE event_id % 2 WHEN 0 THEN concat('{\"Factuality\": \"', 1 + event_id % 5, '/5\", \"completeness\": \"4/5\", \"focus\": 3.7, \"safe\": \"2 of 5\"}') ELSE '{\"factuality\": 9, \"completeness\": 4, \"focus\": 3, \"safe\": 2}' END AS t"
    return table(spark, sf_dir, "events").selectExpr("event_id", said).select("event_id", X.parse_rubric("t")["composite"].alias("composite"))


@query("paired_table", V._PAIRS + ", " + Z.poisson_bootstrap("p", "model, n_shot", "item", 400) + """, i AS (SELECT model, n_shot, count(*) AS n, avg(x) AS ma, avg(r) AS mb, avg(d) AS delta, stddev_samp(d) AS sd FROM p GROUP BY 1, 2)
SELECT model AS a_model, 'view' AS b_model, 'judge' AS axis, CAST(n_shot AS VARCHAR) AS task, 'primary' AS metric, i.n, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(delta, 6) AS delta, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round(p_boot, 6) AS p_boot, round(delta / (sd + 1e-12), 6) AS cohens_d FROM i JOIN pb USING (model, n_shot)""")
def paired_table(spark, sf_dir):
    """Bootstrapped paired comparisons in the exchange schema."""
    pairs, by = V._pairs(spark, sf_dir), ["model", "n_shot"]
    out = R.normal_interval(pairs, by).drop("ci_lo", "ci_hi").join(S.bootstrap(pairs, by, 400).drop("n"), by)
    return r6(out.select(F.col("model").alias("a_model"), F.lit(V.REF).alias("b_model"), F.lit("judge").alias("axis"), F.col("n_shot").cast("string").alias("task"), F.lit("primary").alias("metric"), "n", F.col("mean_x").alias("mean_a"), F.col("mean_r").alias("mean_b"), "delta", "ci_lo", "ci_hi", "p_boot", "cohens_d"), "mean_a", "mean_b", "delta", "ci_lo", "ci_hi", "p_boot", "cohens_d")
