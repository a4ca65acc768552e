"""Queries of the evaluation, judging and statistics operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import metrics as M
from brindle.functions import text as X
from brindle.operators import evaluation as E
from brindle.operators import judging as J
from brindle.operators import qa as Q
from brindle.operators import resampling as RS
from brindle.operators import stats as S
from brindle.plans import stats_sql as Z
from brindle.plans.tables import CELL_SCORES_SQL, DUELS_SQL, ITEMS_SQL, SCORES_SQL, TURN_PAIRS_SQL, cell_scores, duels, items, scores, table, turn_pairs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AXES = ["factual", "complete", "relevance", "safety"]
MODELS = ["click", "error", "purchase", "signup", "view"]
REF = "view"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _without_articles(x: str) -> str:
    """One pass misses the second of two articles in a row, whose space the first has taken."""
    return f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_])(le|la|les|un|une|des|du|de|l'')\\s+', '\\1 ', 'g')"


def _answer(x: str) -> str:
    once = _without_articles(f"lower(trim(coalesce({x}, '')))")
    return f"trim(regexp_replace(regexp_replace({_without_articles(once)}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_LET = "list_sort(list_distinct(list_filter(string_split({0}, ','), lambda x: x != '')))"
_IT = f"SELECT *, {_LET.format('pred')} AS p, {_LET.format('gold')} AS g FROM ({ITEMS_SQL})"


@query("exact_match", f"SELECT conv_id, turn, CAST({_answer('pred')} = {_answer('gold')} AS INT) AS em FROM ({TURN_PAIRS_SQL})")
def exact_match(spark, sf_dir):
    """M4, T7."""
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", M.exact_match("pred", "gold").alias("em"))


_TOK = "list_filter(string_split({0}, ' '), lambda w: w != '')"


_F1 = f"""
WITH a AS (SELECT row_number() OVER () AS r, conv_id, turn, {_answer('pred')} AS ps, {_answer('gold')} AS gs FROM ({TURN_PAIRS_SQL})),
p AS (SELECT r, w, count(*) AS k FROM (SELECT r, unnest({_TOK.format('ps')}) AS w FROM a) GROUP BY ALL), g AS (SELECT r, w, count(*) AS k FROM (SELECT r, unnest({_TOK.format('gs')}) AS w FROM a) GROUP BY ALL),
m AS (SELECT r, sum(least(p.k, g.k)) AS same FROM p JOIN g USING (r, w) GROUP BY r), n AS (SELECT r, conv_id, turn, CAST(ps = gs AS INT) AS em, len({_TOK.format('ps')}) AS np, len({_TOK.format('gs')}) AS ng FROM a),
f AS (SELECT conv_id, turn, em, CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 ELSE 2.0 * coalesce(same, 0) / (np + ng) END AS f1 FROM n LEFT JOIN m USING (r))
"""


@query("token_f1", _F1 + "SELECT conv_id, turn, round(f1, 6) AS f1 FROM f")
def token_f1(spark, sf_dir):
    """M5."""
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(M.token_f1("pred", "gold"), 6).alias("f1"))


_METRICS = f"WITH RECURSIVE tp AS (SELECT row_number() OVER () AS r, conv_id, turn, pred, gold FROM ({TURN_PAIRS_SQL})), {Z.TEXT_METRICS}"


@query("rouge_bleu", _METRICS + "SELECT conv_id, turn, round(rouge_l, 6) AS rouge_l, round(bleu4, 6) AS bleu4 FROM tp JOIN rl USING (r) JOIN bl USING (r)")
def rouge_bleu(spark, sf_dir):
    """M6, M7."""
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(M.rouge_l("pred", "gold"), 6).alias("rouge_l"), F.round(M.bleu4("pred", "gold"), 6).alias("bleu4"))


@query("extqa_cells", _F1 + "SELECT turn, round(avg(em), 6) AS em, round(avg(f1), 6) AS token_f1, count(*) AS n FROM f GROUP BY turn")
def extqa_cells(spark, sf_dir):
    """A6 by turn."""
    return r6(E.score_extqa(turn_pairs(spark, sf_dir), ("turn",)), "em", "token_f1")


@query("absqa_cells", _METRICS + "SELECT turn, round(avg(rouge_l), 6) AS rouge_l, round(avg(bleu4), 6) AS bleu4, CAST(NULL AS DOUBLE) AS bertscore_f1, count(*) AS n FROM tp JOIN rl USING (r) JOIN bl USING (r) GROUP BY turn")
def absqa_cells(spark, sf_dir):
    """A7 by turn."""
    return r6(E.score_absqa(turn_pairs(spark, sf_dir), ("turn",)), "rouge_l", "bleu4")


_MACRO = f"""
WITH i AS ({_IT}), b AS (SELECT model, n_shot, avg(CAST(p = g AS INT)) AS accuracy, avg((5 - (len(p) + len(g) - 2 * len(list_intersect(p, g)))) / 5.0) AS hamming, count(*) AS n FROM i GROUP BY 1, 2),
l AS (SELECT model, n_shot, p, g, unnest(['A', 'B', 'C', 'D', 'E']) AS letter FROM i),
c AS (SELECT model, n_shot, letter, count(*) FILTER (WHERE list_contains(p, letter) AND list_contains(g, letter)) AS tp, count(*) FILTER (WHERE list_contains(p, letter) AND NOT list_contains(g, letter)) AS fp, count(*) FILTER (WHERE NOT list_contains(p, letter) AND list_contains(g, letter)) AS fn FROM l GROUP BY ALL),
f AS (SELECT model, n_shot, avg(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END) AS macro_f1 FROM c WHERE tp + fp + fn > 0 GROUP BY 1, 2)
"""


@query("mcqa_cells", _MACRO + "SELECT model, n_shot, round(accuracy, 6) AS accuracy, round(hamming, 6) AS hamming, n, round(coalesce(macro_f1, 0), 6) AS macro_f1 FROM b LEFT JOIN f USING (model, n_shot)")
def mcqa_cells(spark, sf_dir):
    """M1, M2, M3, A5."""
    return r6(E.score_mcqa(items(spark, sf_dir)), "accuracy", "hamming", "macro_f1")


@query("eval_summary", _MACRO + "SELECT 'mcqa' AS task, model, n_shot, metric, round(value, 6) AS value FROM (SELECT model, n_shot, accuracy, hamming, coalesce(macro_f1, 0) AS macro_f1 FROM b LEFT JOIN f USING (model, n_shot)) UNPIVOT (value FOR metric IN (accuracy, hamming, macro_f1))")
def eval_summary(spark, sf_dir):
    """One long table of all cells' metrics."""
    cells = E.score_mcqa(items(spark, sf_dir))
    return r6(cells.unpivot(["model", "n_shot"], ["accuracy", "hamming", "macro_f1"], "metric", "value"), "value").select(F.lit("mcqa").alias("task"), "model", "n_shot", "metric", "value")


@query("parse_letters", r"SELECT event_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(upper(t), '\b([A-Z])\b', 1), lambda x: x <= 'E'))), ',') AS letters FROM (SELECT event_id, concat('Answer ', substr(event_type, 1, 1), ' or b; not Z, maybe ', substr(event_type, 2, 1)) AS t FROM events)")
def parse_letters(spark, sf_dir):
    """T21."""
    t = F.concat(F.lit("Answer "), F.substring("event_type", 1, 1), F.lit(" or b; not Z, maybe "), F.substring("event_type", 2, 1))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(X.letters(t), ",").alias("letters"))


@query("gold_letters", f"SELECT pos, array_to_string({_LET.format('upper(gold)')}, ',') AS gold FROM ({ITEMS_SQL})")
def gold_letters(spark, sf_dir):
    """T22."""
    return items(spark, sf_dir).select("pos", F.array_join(X.gold_letters("gold"), ",").alias("gold"))


@query("route_answers", f"SELECT pos, CASE WHEN pred != '' OR raw = '' THEN 'done' WHEN regexp_matches(upper(raw), '\\b[A-E]\\b') THEN 'recovered' ELSE 'judge' END AS route FROM ({ITEMS_SQL})")
def route_answers(spark, sf_dir):
    """Which answers need a judge."""
    return items(spark, sf_dir).select("pos", X.route("pred", "raw")["route"].alias("route"))


_AGAIN = "array_to_string(list_sort(list_distinct(regexp_extract_all(upper(raw), '\\b[A-E]\\b'))), ',')"
_ROUTED = f"SELECT * EXCLUDE (pred), coalesce(nullif(CASE WHEN pred = '' AND raw != '' THEN {_AGAIN} END, ''), pred) AS pred, max(CASE WHEN pred = '' AND raw != '' AND {_AGAIN} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY model, n_shot) AS touched FROM ({ITEMS_SQL})"
_RESCORED = _MACRO.replace(_IT, f"SELECT *, {_LET.format('pred')} AS p, {_LET.format('gold')} AS g FROM ({_ROUTED}) WHERE touched = 1")


@query("rescored_cells", _RESCORED + "SELECT model, n_shot, round(accuracy, 6) AS accuracy, round(hamming, 6) AS hamming, n, round(coalesce(macro_f1, 0), 6) AS macro_f1 FROM b LEFT JOIN f USING (model, n_shot)")
def rescored_cells(spark, sf_dir):
    """Cells with judged rows scored again."""
    routed = items(spark, sf_dir).withColumn("__r", X.route("pred", "raw")).select("*", "__r.route", "__r.pred_judged").drop("__r")
    return r6(E.rescored(routed), "accuracy", "hamming", "macro_f1")


_CLASS = "CASE WHEN len(p) = 0 THEN 'format_failure' WHEN p = g THEN 'correct' WHEN len(list_intersect(p, g)) = 0 THEN 'all_wrong' WHEN len(list_intersect(p, g)) = len(p) THEN 'under_predict' WHEN len(list_intersect(p, g)) = len(g) THEN 'over_predict' ELSE 'partial_match' END"


@query("error_taxonomy", f"SELECT model, n_shot, {', '.join(f'''round(count(*) FILTER (WHERE c = '{e}') / count(*), 6) AS {e}''' for e in E.ERRORS)}, count(*) AS n FROM (SELECT *, {_CLASS} AS c FROM ({_IT})) GROUP BY 1, 2")
def error_taxonomy(spark, sf_dir):
    """T30, A23."""
    rows = items(spark, sf_dir)
    return r6(E.error_fractions(rows, pred=X.gold_letters("pred"), gold=X.gold_letters("gold"), cleaned="raw"), *E.ERRORS)


@query("coarse_ece", f"SELECT model, round(1 - avg(CAST(p = g AS INT)), 6) AS ece FROM ({_IT}) GROUP BY 1")
def coarse_ece(spark, sf_dir):
    """A24 with the placeholder confidence."""
    return r6(E.calibration_error(items(spark, sf_dir), ("model",), correct=M.set_accuracy("pred", "gold")), "ece")


@query("calibration_bins", "WITH b AS (SELECT event_type AS model, least(floor(value / 500.0 * 10), 9) AS bin, value / 500.0 AS c, CAST(user_id % 3 = 0 AS INT) AS ok FROM events), g AS (SELECT model, bin, count(*) AS k, avg(ok) AS a, avg(c) AS c FROM b GROUP BY 1, 2) SELECT model, round(sum(k * abs(a - c)) / sum(k), 6) AS ece FROM g GROUP BY model")
def calibration_bins(spark, sf_dir):
    """A24 with a confidence column."""
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "model")
    return r6(E.calibration_error(rows, ("model",), correct=F.col("user_id") % 3 == 0, confidence=F.col("value") / 500.0), "ece")


@query("missing_cells", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus != 'O')")
def missing_cells(spark, sf_dir):
    """Work list by anti join; cells without a valid item count as missing."""
    done = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_total"), F.count_if(F.col("o_orderstatus") != "O").alias("n_valid"))
    return E.missing_cells(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("item_dedup", f"SELECT item, pos FROM (SELECT item, pos, row_number() OVER (PARTITION BY item ORDER BY pos) AS r FROM ({ITEMS_SQL})) WHERE r = 1")
def item_dedup(spark, sf_dir):
    """A32."""
    return E.first_by(items(spark, sf_dir), ["item"], "pos").select("item", "pos")


@query("coverage", f"SELECT model, array_to_string(list_sort(list(DISTINCT n_shot)), ',') AS covered FROM ({ITEMS_SQL}) GROUP BY 1")
def coverage(spark, sf_dir):
    """A29."""
    return J.coverage(items(spark, sf_dir), ["model"], "n_shot").select("model", F.array_join("covered", ",").alias("covered"))


_CELLS = f"SELECT model, n_shot, avg(score) AS v FROM ({SCORES_SQL}) GROUP BY 1, 2"


def _cells(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("model", "n_shot").agg(F.avg("score").alias("v"))


@query("metric_pivot", f"SELECT model, round(avg(v) FILTER (WHERE n_shot = 0), 4) AS \"0\", round(avg(v) FILTER (WHERE n_shot = 3), 4) AS \"3\", round(avg(v) FILTER (WHERE n_shot = 5), 4) AS \"5\" FROM ({_CELLS}) GROUP BY 1")
def metric_pivot(spark, sf_dir):
    """A18."""
    return E.pivot_mean(_cells(spark, sf_dir), "model", ["n_shot"], "v", ["0", "3", "5"])


@query("delta_to_reference", f"WITH c AS ({_CELLS}) SELECT c.model, c.n_shot, round(c.v, 6) AS v, round(c.v - r.v, 6) AS delta, round((c.v - r.v) / r.v * 100, 6) AS pct FROM c JOIN c r ON c.n_shot = r.n_shot AND r.model = '{REF}' WHERE c.model != '{REF}'")
def delta_to_reference(spark, sf_dir):
    """A19."""
    return r6(E.delta_to(_cells(spark, sf_dir), REF, ["n_shot"], "v"), "v", "delta", "pct")


@query("rescaled_spread", f"SELECT model, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS sd, round(min(x), 6) AS least, round(max(x), 6) AS greatest, round(max(x) - min(x), 6) AS range, round(100 * coalesce(stddev_samp(x), 0) / avg(x), 6) AS cv FROM (SELECT model, (v - 1) / 4 AS x FROM ({_CELLS})) GROUP BY 1")
def rescaled_spread(spark, sf_dir):
    """A20, A21, A22."""
    return r6(E.spread(_cells(spark, sf_dir).withColumn("x", (F.col("v") - 1) / 4), ["model"], "x"), "mean", "sd", "least", "greatest", "range", "cv")


@query("best_shot", f"SELECT model, n_shot FROM (SELECT model, n_shot, row_number() OVER (PARTITION BY model ORDER BY round(v, 9) DESC, n_shot) AS r FROM ({_CELLS})) WHERE r = 1")
def best_shot(spark, sf_dir):
    """P14."""
    return E.best_per(_cells(spark, sf_dir).withColumn("v", F.round("v", 9)), ["model"], "v", "n_shot").select("model", "n_shot")


@query("axis_breakdown", f"SELECT judge, model, n_shot, axis, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS sd, count(score) AS n FROM ({SCORES_SQL}) GROUP BY ALL")
def axis_breakdown(spark, sf_dir):
    """A11."""
    return r6(J.axis_breakdown(scores(spark, sf_dir), ["judge", "model", "n_shot", "axis"]), "mean", "sd")


_RUBRIC = "SELECT event_type AS model, CAST(1 + event_id % 5 AS DOUBLE) AS factual, CAST(1 + user_id % 5 AS DOUBLE) AS safety, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(1 + (event_id + user_id) % 5 AS DOUBLE) END AS composite FROM events"


@query("judge_axis_means", f"SELECT model, round(avg(factual) FILTER (WHERE composite IS NOT NULL), 6) AS factual, round(avg(safety) FILTER (WHERE composite IS NOT NULL), 6) AS safety, round(avg(composite), 6) AS composite, round(count(composite) / count(*), 6) AS valid_share FROM ({_RUBRIC}) GROUP BY 1")
def judge_axis_means(spark, sf_dir):
    """A10."""
    e = table(spark, sf_dir, "events")
    rows = e.selectExpr("event_type AS model", "CAST(1 + event_id % 5 AS DOUBLE) AS factual", "CAST(1 + user_id % 5 AS DOUBLE) AS safety", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(1 + (event_id + user_id) % 5 AS DOUBLE) END AS composite")
    return r6(J.axis_means(rows, ["model"], ["factual", "safety"]), "factual", "safety", "composite", "valid_share")


@query("consensus", f"SELECT model, n_shot, item, axis, round(avg(score), 6) AS score, count(*) AS n_judges FROM ({SCORES_SQL}) GROUP BY ALL")
def consensus(spark, sf_dir):
    """A12."""
    return r6(J.consensus(scores(spark, sf_dir), ["model", "n_shot", "item", "axis"]), "score")


@query("pointwise_summary", f"WITH s AS ({SCORES_SQL}), c AS (SELECT model, n_shot, item, avg(score) AS score FROM s GROUP BY ALL), a AS (SELECT model, n_shot, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, count(*) AS n FROM c GROUP BY ALL), j AS (SELECT model, n_shot, round(avg(score) FILTER (WHERE judge = 'j0'), 6) AS j0, round(avg(score) FILTER (WHERE judge = 'j1'), 6) AS j1 FROM s GROUP BY ALL) SELECT * FROM a JOIN j USING (model, n_shot)")
def pointwise_summary(spark, sf_dir):
    """A13."""
    return r6(J.pointwise_summary(scores(spark, sf_dir), ["model", "n_shot"], ["item"], ["j0", "j1"]), "mean", "sd", "j0", "j1")


@query("consensus_heatmap", f"SELECT model, axis, round(avg(m), 6) AS mean FROM (SELECT judge, model, axis, avg(score) AS m FROM ({SCORES_SQL}) GROUP BY ALL) GROUP BY ALL")
def consensus_heatmap(spark, sf_dir):
    """A17."""
    return r6(J.mean_of_means(scores(spark, sf_dir), ["model", "axis"]), "mean")


@query("dimension_delta", f"WITH m AS (SELECT model, n_shot, axis, avg(score) AS m FROM ({SCORES_SQL}) GROUP BY ALL) SELECT a.model, a.axis, round(avg(a.m - r.m), 6) AS delta FROM m a JOIN m r ON a.n_shot = r.n_shot AND a.axis = r.axis AND r.model = '{REF}' WHERE a.model != '{REF}' GROUP BY ALL")
def dimension_delta(spark, sf_dir):
    """A25."""
    return r6(J.dimension_delta(scores(spark, sf_dir), REF), "delta")


_SETTLED = f"""
WITH d AS (SELECT *, CASE verdict_ab WHEN 'A' THEN 'challenger' WHEN 'B' THEN 'opponent' WHEN 'TIE' THEN 'tie' END AS w1, CASE verdict_ba WHEN 'B' THEN 'challenger' WHEN 'A' THEN 'opponent' WHEN 'TIE' THEN 'tie' END AS w2 FROM ({DUELS_SQL})),
s AS (SELECT *, CASE WHEN w1 IS NULL THEN w2 WHEN w2 IS NULL THEN w1 WHEN w1 = w2 THEN w1 ELSE 'tie' END AS winner, coalesce(w1 = w2, false) AS consistent FROM d),
r AS (SELECT judge, challenger, count(*) FILTER (WHERE winner = 'challenger') AS wins, count(*) FILTER (WHERE winner = 'opponent') AS losses, count(*) FILTER (WHERE winner = 'tie') AS ties, count(winner) AS n, count(*) AS n_attempted, count(*) FILTER (WHERE consistent) / greatest(1, count(winner)) AS position_consistency FROM s GROUP BY 1, 2)
"""


def _rollup(spark, sf_dir):
    return J.duel_rollup(J.settle_duels(duels(spark, sf_dir)), ["judge", "challenger"])


@query("duel_rollup", _SETTLED + "SELECT judge, challenger, wins, losses, ties, n, n_attempted, round(position_consistency, 6) AS position_consistency, round(wins / nullif(wins + losses, 0), 6) AS win_rate, round((wins - losses) / greatest(1, n), 6) AS net_preference FROM r")
def duel_rollup(spark, sf_dir):
    """T29, A14, A15."""
    return r6(J.preference(_rollup(spark, sf_dir)), "position_consistency", "win_rate", "net_preference")


@query("duels_pooled", _SETTLED + "SELECT challenger, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(losses) AS BIGINT) AS losses, CAST(sum(ties) AS BIGINT) AS ties, CAST(sum(n) AS BIGINT) AS n, round(sum(wins) / nullif(sum(wins) + sum(losses), 0), 6) AS win_rate, round((sum(wins) - sum(losses)) / greatest(1, sum(n)), 6) AS net_preference FROM r GROUP BY 1")
def duels_pooled(spark, sf_dir):
    """A16."""
    return r6(J.pooled(_rollup(spark, sf_dir), ["challenger"]), "win_rate", "net_preference")


@query("duel_sign_tests", _SETTLED + f", p AS (SELECT judge, challenger, wins, losses, least(1.0, 2 * {Z.half_tail('least(wins, losses)', '(wins + losses)')}) AS p_sign FROM r), i AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_sign, judge, challenger) AS i FROM p) SELECT judge, challenger, wins, losses, round(p_sign, 6) AS p_sign, round(least(1.0, min(p_sign * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM i")
def duel_sign_tests(spark, sf_dir):
    """H9, H10 over duels."""
    tested = J.with_sign_test(_rollup(spark, sf_dir))
    return r6(S.benjamini_hochberg(tested, "p_sign", [], ["judge", "challenger"]), "p_sign", "q").select("judge", "challenger", "wins", "losses", "p_sign", "q")


_PAIRS = f"WITH c AS ({CELL_SCORES_SQL}), p AS (SELECT a.model, a.n_shot, a.item, a.score AS x, r.score AS r, a.score - r.score AS d FROM c a JOIN c r ON a.n_shot = r.n_shot AND a.item = r.item AND r.model = '{REF}' WHERE a.model != '{REF}')"
_STATS = _PAIRS + ", s AS (SELECT model, n_shot, count(*) AS n, avg(x) AS mean_x, avg(r) AS mean_r, avg(d) AS delta, stddev_samp(d) AS sd FROM p GROUP BY 1, 2 HAVING count(*) >= 5), z AS (SELECT *, delta / (sd / sqrt(n)) AS t, delta / sd AS dz FROM s), e AS (SELECT *, sqrt(1 / n + dz * dz / (2 * n)) AS dz_se FROM z)"


def _pairs(spark, sf_dir):
    return S.paired(cell_scores(spark, sf_dir), REF, ["n_shot"], "item")


@query("paired_stats", _STATS + "SELECT model, n_shot, n, round(mean_x, 6) AS mean_x, round(mean_r, 6) AS mean_r, round(delta, 6) AS delta, round(sd, 6) AS sd, round(t, 6) AS t, round(dz, 6) AS dz, round(dz_se, 6) AS dz_se, round(dz - 1.959964 * dz_se, 6) AS dz_lo, round(dz + 1.959964 * dz_se, 6) AS dz_hi FROM e")
def paired_stats(spark, sf_dir):
    """H1, H2, H3, J15."""
    return r6(S.paired_stats(_pairs(spark, sf_dir), ["model", "n_shot"]), "mean_x", "mean_r", "delta", "sd", "t", "dz", "dz_se", "dz_lo", "dz_hi")


_RANKS = "WITH RECURSIVE " + Z.RANK_SUM_WAYS + ", " + _STATS.removeprefix("WITH ") + ", " + Z.signed_ranks("p", "model, n_shot")


@query("signed_ranks", _RANKS + ", " + Z.wilcoxon("model, n_shot") + "SELECT model, n_shot, n_pairs, CAST(n AS BIGINT) AS n, CAST(w_plus AS DOUBLE) AS w_plus, CAST(ties AS BIGINT) AS ties, round(p_wilcoxon, 6) AS p_wilcoxon FROM sr JOIN pw USING (model, n_shot)")
def signed_ranks(spark, sf_dir):
    """H6: rank sums made in the plan, and their p."""
    return r6(RS.with_wilcoxon(RS.signed_ranks(_pairs(spark, sf_dir), ["model", "n_shot"])), "p_wilcoxon").withColumn("w_plus", F.col("w_plus").cast("double"))


_EXACT = "x AS (SELECT l_suppkey, l_linenumber, avg(l_quantity - 25.5 + l_extendedprice / 1e6) AS d FROM lineitem WHERE l_suppkey <= 40 GROUP BY ALL)"


@query("signed_ranks_exact", "WITH RECURSIVE " + Z.RANK_SUM_WAYS + ", " + _EXACT + ", " + Z.signed_ranks("x", "l_suppkey") + ", " + Z.wilcoxon("l_suppkey") + "SELECT l_suppkey, n_pairs, CAST(n AS BIGINT) AS n, CAST(w_plus AS DOUBLE) AS w_plus, round(p_wilcoxon, 6) AS p_wilcoxon FROM sr JOIN pw USING (l_suppkey)")
def signed_ranks_exact(spark, sf_dir):
    """H6 on cells of few differences, where p is exact."""
    x = table(spark, sf_dir, "lineitem").filter("l_suppkey <= 40").groupBy("l_suppkey", "l_linenumber").agg(F.avg(F.expr("l_quantity - 25.5 + l_extendedprice / 1e6")).alias("d"))
    out = r6(RS.with_wilcoxon(RS.signed_ranks(x, ["l_suppkey"])), "p_wilcoxon")
    return out.select("l_suppkey", "n_pairs", "n", F.col("w_plus").cast("double").alias("w_plus"), "p_wilcoxon")


_TT = Z.t_tail("t", "(n - 1)")
_TESTS = _RANKS + ", " + Z.wilcoxon("model, n_shot") + f"""
, v AS (SELECT model, n_shot, n, delta, sd, dz, dz_se, 2 * {_TT} AS p_t, p_wilcoxon, (dz + 0.2) / dz_se AS z1, (dz - 0.2) / dz_se AS z2, (delta + 0.2 * sd) / (sd / sqrt(n)) AS t1, (delta - 0.2 * sd) / (sd / sqrt(n)) AS t2 FROM e JOIN pw USING (model, n_shot)),
u AS (SELECT *, coalesce(p_wilcoxon, p_t, 1.0) AS p_primary, greatest(1 - {Z.normal_cdf('z1')}, {Z.normal_cdf('z2')}) AS p_tost, dz - 1.644854 * dz_se > -0.2 AND dz + 1.644854 * dz_se < 0.2 AS equivalent,
  greatest(1 - {Z.t_cdf('t1', '(n - 1)')}, {Z.t_cdf('t2', '(n - 1)')}) AS p_tost_t FROM v),
i AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_primary, model, n_shot) AS i FROM u),
q AS (SELECT *, least(1.0, min(p_primary * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM i)
SELECT model, n_shot, n, round(p_t, 6) AS p_t, round(p_wilcoxon, 6) AS p_wilcoxon, round(p_primary, 6) AS p_primary, round(q, 6) AS q, round(least(1.0, p_primary * m), 6) AS p_bonferroni, round(p_tost, 6) AS p_tost, equivalent, round(p_tost_t, 6) AS p_tost_t, p_tost_t < 0.05 AS equivalent_t,
  CASE WHEN q < 0.001 THEN '***' WHEN q < 0.01 THEN '**' WHEN q < 0.05 THEN '*' ELSE '' END AS stars,
  CASE WHEN q < 0.05 AND delta > 0 THEN 'PREFERRED' WHEN q < 0.05 AND delta < 0 THEN 'WORSE' WHEN equivalent THEN 'EQUIVALENT' ELSE 'no reliable difference' END AS verdict FROM q
"""


@query("paired_tests", _TESTS)
def paired_tests(spark, sf_dir):
    """P-values, corrections, equivalence and verdicts."""
    pairs, by = _pairs(spark, sf_dir), ["model", "n_shot"]
    out = S.equivalence(S.with_p_values(S.paired_stats(pairs, by), pairs, by))
    out = S.bonferroni(S.benjamini_hochberg(out, "p_primary", [], by), "p_primary", [])
    out = out.withColumns({"stars": S.stars("q"), "verdict": S.verdict("delta", "q", "equivalent")})
    return r6(out, "p_t", "p_wilcoxon", "p_primary", "q", "p_bonferroni", "p_tost", "p_tost_t").select("model", "n_shot", "n", "p_t", "p_wilcoxon", "p_primary", "q", "p_bonferroni", "p_tost", "equivalent", "p_tost_t", "equivalent_t", "stars", "verdict")


@query("bootstrap_ci", _PAIRS + ", " + Z.poisson_bootstrap("p", "model, n_shot", "item", 400) + "SELECT model, n_shot, n, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round(p_boot, 6) AS p_boot FROM pb")
def bootstrap_ci(spark, sf_dir):
    """400 Poisson replicates."""
    return r6(S.bootstrap(_pairs(spark, sf_dir), ["model", "n_shot"], 400), "ci_lo", "ci_hi", "p_boot")


@query("bh_fdr", "WITH p AS (SELECT p_partkey AS k, p_size AS fam, (p_partkey * 7919 % 9973 + 0.5) / 9973.0 AS p FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY fam) AS m, row_number() OVER (PARTITION BY fam ORDER BY p, k) AS i FROM p) SELECT k, fam, round(least(1.0, min(p * m / i) OVER (PARTITION BY fam ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q, round(least(1.0, p * m), 9) AS p_bonferroni FROM r")
def bh_fdr(spark, sf_dir):
    """H10, H11 in families."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("fam"), ((F.col("p_partkey") * 7919 % 9973 + 0.5) / 9973.0).alias("p"))
    out = S.bonferroni(S.benjamini_hochberg(rows, "p", ["fam"], ["k"]), "p", ["fam"])
    return out.select("k", "fam", F.round("q", 9).alias("q"), F.round("p_bonferroni", 9).alias("p_bonferroni"))


@query("mcnemar_counts", _PAIRS + "SELECT model, n_shot, count(*) FILTER (WHERE x - 3 > 0 AND r - 3 <= 0) AS b, count(*) FILTER (WHERE x - 3 <= 0 AND r - 3 > 0) AS c, count(*) AS n FROM p GROUP BY 1, 2")
def mcnemar_counts(spark, sf_dir):
    """H8's counts; an answer is right above 3."""
    pairs = _pairs(spark, sf_dir).withColumns({"x": F.col("x") - 3, "r": F.col("r") - 3})
    return S.mcnemar_counts(pairs, ["model", "n_shot"]).select("model", "n_shot", "b", "c", "n")


@query("mcnemar_tests", _PAIRS + f", m AS (SELECT model, n_shot, count(*) FILTER (WHERE x - 3 > 0 AND r - 3 <= 0) AS b, count(*) FILTER (WHERE x - 3 <= 0 AND r - 3 > 0) AS c, count(*) AS n FROM p GROUP BY 1, 2), w AS (SELECT *, {Z.mcnemar('b', 'c')} AS p_raw FROM m) SELECT model, n_shot, b, c, n, round(p_raw, 6) AS p_raw, round(least(1.0, p_raw), 6) AS p FROM w")
def mcnemar_tests(spark, sf_dir):
    """H8 with raw and capped p."""
    pairs = _pairs(spark, sf_dir).withColumns({"x": F.col("x") - 3, "r": F.col("r") - 3})
    return r6(S.mcnemar_counts(pairs, ["model", "n_shot"]), "p_raw", "p")


_ITEM_MODEL = f"SELECT model, item, avg(score) AS score FROM ({SCORES_SQL}) GROUP BY 1, 2"


def _item_model(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("model", "item").agg(F.avg("score").alias("score"))


@query("average_ranks", f"WITH c AS ({_ITEM_MODEL}), r AS (SELECT model, rank() OVER (PARTITION BY item ORDER BY score DESC) + (count(*) OVER (PARTITION BY item, score) - 1) / 2.0 AS rk FROM c) SELECT model, round(avg(rk), 6) AS avg_rank, count(*) AS n_items FROM r GROUP BY 1")
def average_ranks(spark, sf_dir):
    """H15 with average ties."""
    return r6(S.average_ranks(_item_model(spark, sf_dir), ["item"]), "avg_rank")


@query("ordinal_ranks", f"WITH c AS ({_ITEM_MODEL}), r AS (SELECT model, row_number() OVER (PARTITION BY item ORDER BY score DESC, model) AS rk FROM c) SELECT model, round(avg(rk), 6) AS avg_rank, count(*) AS n_items FROM r GROUP BY 1")
def ordinal_ranks(spark, sf_dir):
    """H15 with ordinal ties."""
    return r6(S.average_ranks(_item_model(spark, sf_dir), ["item"], ties="ordinal"), "avg_rank")


@query("friedman_stat", f"WITH c AS ({_ITEM_MODEL}), f AS (SELECT * FROM c WHERE item IN (SELECT item FROM c GROUP BY item HAVING count(*) = 5)), r AS (SELECT model, rank() OVER (PARTITION BY item ORDER BY score) + (count(*) OVER (PARTITION BY item, score) - 1) / 2.0 AS rk, power(count(*) OVER (PARTITION BY item, score), 2) - 1 AS tie FROM f), s AS (SELECT model, sum(rk) AS s, count(*) AS n, sum(tie) AS tie FROM r GROUP BY 1), t AS (SELECT sum(s * s) AS ss, max(n) AS n, count(*) AS k, sum(tie) AS tie FROM s) SELECT n AS n_items, k, round((12 * ss / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - tie / (n * k * (k * k - 1))), 6) AS chi2, round(2.728 * sqrt(k * (k + 1) / (6.0 * n)), 6) AS cd FROM t")
def friedman_stat(spark, sf_dir):
    """Statistic and critical difference."""
    out = S.friedman(_item_model(spark, sf_dir), "item").withColumn("cd", S.critical_difference("k", "n_items"))
    return r6(out, "chi2", "cd").select("n_items", "k", "chi2", "cd")


@query("judge_agreement", f"WITH s AS ({SCORES_SQL}), b AS (SELECT item, avg(score) FILTER (WHERE judge = 'j0') AS x, avg(score) FILTER (WHERE judge = 'j1') AS y FROM s GROUP BY 1), c AS (SELECT * FROM b WHERE x IS NOT NULL AND y IS NOT NULL), r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM c) SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(avg(x - y), 6) AS \"offset\" FROM r")
def judge_agreement(spark, sf_dir):
    """H17."""
    return r6(J.agreement(scores(spark, sf_dir), ["item"], "j0", "j1"), "pearson", "spearman", "offset")


@query("judge_kappa", "WITH l AS (SELECT l_returnflag AS a, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS b FROM lineitem), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS same FROM l), e AS (SELECT coalesce(sum(ra * rb), 0) AS c FROM (SELECT a AS k, count(*) AS ra FROM l GROUP BY 1) JOIN (SELECT b AS k, count(*) AS rb FROM l GROUP BY 1) USING (k)) SELECT n, round((same / n - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa FROM n, e")
def judge_kappa(spark, sf_dir):
    """H22."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("a"), F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("b"))
    return r6(J.kappa(rows, "a", "b"), "kappa")


_VERDICT = "SELECT event_type AS source, (event_id % 11 - 5) / 100.0 AS delta, (event_id * 7 % 97) / 97.0 AS p, (event_id % 9 - 4) / 10.0 AS dz FROM events"


@query("verdict_counts", f"WITH v AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE delta > 0) AS wins, count(*) FILTER (WHERE p < 0.05 AND delta > 0) AS sig_wins, count(*) FILTER (WHERE p < 0.05 AND delta < 0) AS sig_losses, count(*) FILTER (WHERE abs(delta) < 0.005) AS ties, round(avg(delta), 6) AS mean_delta, round(avg(dz), 6) AS mean_effect, round(quantile_cont(p, 0.5), 6) AS median_p FROM ({_VERDICT}) GROUP BY 1) SELECT *, CASE WHEN sig_wins >= 3 AND sig_losses = 0 THEN 'sig_better' WHEN sig_wins > sig_losses THEN 'mixed_better' WHEN sig_wins = 0 AND sig_losses = 0 THEN 'tied' WHEN sig_losses > sig_wins THEN 'worse' ELSE 'mixed' END AS verdict FROM v")
def verdict_counts(spark, sf_dir):
    """A30, A31, A33, H24."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("source"), ((F.col("event_id") % 11 - 5) / 100.0).alias("delta"), ((F.col("event_id") * 7 % 97) / 97.0).alias("p"), ((F.col("event_id") % 9 - 4) / 10.0).alias("dz"))
    out = S.verdict_counts(rows, ["source"]).withColumn("verdict", S.reviewer_verdict("sig_wins", "sig_losses"))
    return r6(out, "mean_delta", "mean_effect", "median_p")


_SEEDS = "SELECT CAST(year(o_orderdate) AS INT) AS seed, o_orderpriority AS model, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2"


def _seeds(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("seed"), F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("value"))


@query("seed_summary", f"SELECT model, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, count(value) AS n FROM ({_SEEDS}) GROUP BY 1")
def seed_summary(spark, sf_dir):
    """A26's mean and sd."""
    return J.seed_summary(_seeds(spark, sf_dir), ["model"]).select("model", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n")


@query("seed_intervals", f"WITH q(df, t) AS (VALUES {', '.join(f'({i + 1}, {t})' for i, t in enumerate(Z.T_975))}), s AS (SELECT model, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM ({_SEEDS}) GROUP BY 1) SELECT model, round(mean, 3) AS mean, round(sd, 3) AS sd, round(t * sd / sqrt(n), 3) AS ci95, n FROM s LEFT JOIN q ON df = n - 1")
def seed_intervals(spark, sf_dir):
    """A26 with t intervals."""
    return J.seed_summary(_seeds(spark, sf_dir), ["model"]).select("model", *[F.round(c, 3).alias(c) for c in ("mean", "sd", "ci95")], "n")


@query("vanilla_once", f"WITH s AS ({_SEEDS}) SELECT seed, model, round(value, 4) AS value FROM s WHERE model != '1-URGENT' OR seed = (SELECT min(seed) FROM s)")
def vanilla_once(spark, sf_dir):
    """A27."""
    return J.once_per_seed(_seeds(spark, sf_dir), "1-URGENT").withColumn("value", F.round("value", 4))


@query("numeric_items", "SELECT p_partkey, metric, round(value, 4) AS value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part) UNPIVOT (value FOR metric IN (p_size, p_retailprice))")
def numeric_items(spark, sf_dir):
    """Numeric leaves as rows."""
    return J.unpivot_numbers(table(spark, sf_dir, "part"), ["p_partkey"]).withColumn("value", F.round("value", 4))


_JSON = "CASE event_id % 4 WHEN 0 THEN concat('{\"factual\": ', 1 + event_id % 5, ', \"complete\": ', 1 + user_id % 5, ', \"relevance\": 3, \"safety\": 5}') WHEN 1 THEN concat('factual: ', 1 + event_id % 5, ' complete: ', 1 + user_id % 5, ' relevance = 3 safety: 5') WHEN 2 THEN concat(1 + event_id % 5, ' ', 1 + user_id % 5, ' 3 5') ELSE 'no idea' END"


@query("judge_parse", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (1 + event_id % 5 + 1 + user_id % 5 + 8) / 4.0 END AS composite FROM events")
def judge_parse(spark, sf_dir):
    """Three layers of the rubric parser."""
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_JSON} AS t").select("event_id", X.parse_rubric("t")["composite"].alias("composite"))


@query("verdict_parse", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'TIE' WHEN 3 THEN 'B' END AS verdict FROM events")
def verdict_parse(spark, sf_dir):
    """T28."""
    text = "CASE event_id % 5 WHEN 0 THEN '{\"winner\": \"A\", \"reason\": \"B est faux\"}' WHEN 1 THEN 'WINNER = B' WHEN 2 THEN '{\"winner\":\"ÉGALITÉ\"}' WHEN 3 THEN 'je choisis b' ELSE '' END"
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{text} AS t").select("event_id", X.parse_verdict("t").alias("verdict"))


@query("model_groups", "SELECT p_brand, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'perplexity' WHEN starts_with(p_brand, 'Brand#2') THEN 'noppl' ELSE 'excluded' END AS grp, count(*) AS n FROM part GROUP BY 1, 2")
def model_groups(spark, sf_dir):
    """T31."""
    return table(spark, sf_dir, "part").groupBy("p_brand", X.model_group("p_brand", {"Brand#1": "perplexity", "Brand#2": "noppl"}).alias("grp")).agg(F.count("*").alias("n"))


@query("pred_or_raw", "SELECT doc_id, right(coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), text), 1500) AS t FROM documents")
def pred_or_raw(spark, sf_dir):
    """T24, T26."""
    d = table(spark, sf_dir, "documents").withColumn("pred", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")))
    return d.select("doc_id", F.right(X.pred_or_raw("pred", "text"), F.lit(1500)).alias("t"))


@query("clean_generation", "SELECT conv_id, turn, trim(text) AS t FROM conversations")
def clean_generation(spark, sf_dir):
    """Reasoning and control tokens around a turn's text go."""
    t = F.concat(F.lit("<think>x\ny</think><|im_start|>assistant"), "text", F.lit("<|im_end|><THINK>tail"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.clean_generation(t).alias("t"))


@query("short_spans", r"SELECT conv_id, turn, array_to_string(list_slice(regexp_split_to_array(trim(string_split(trim(text), chr(10))[1]), '\s+'), 1, 20), ' ') AS t FROM conversations")
def short_spans(spark, sf_dir):
    """T20."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.trim_to_span("text").alias("t"))


def _qa(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("question"), F.create_map(F.lit("A"), "p_brand", F.lit("B"), "p_type").alias("answers"), F.when(F.col("p_size") % 2 == 0, "b,a").otherwise("a").alias("correct_answers"), F.col("p_type").alias("subject"))


@query("normalise_mcqa", "SELECT CAST(p_partkey AS VARCHAR) AS id, 'mcqa' AS task, p_name AS question, CASE WHEN p_size % 2 = 0 THEN 'A,B' ELSE 'A' END AS answer, p_type AS specialty, 'part' AS source FROM part")
def normalise_mcqa(spark, sf_dir):
    """G1."""
    return Q.normalise_mcqa(_qa(spark, sf_dir), "part").select("id", "task", "question", "answer", "specialty", "source")


@query("normalise_absqa", "SELECT CAST(doc_id AS VARCHAR) AS id, 'absqa' AS task, source AS question, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'x' || lang END AS answer FROM documents")
def normalise_absqa(spark, sf_dir):
    """The long answer, else the short one."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("question"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("x"), "lang")).alias("long_answer"), F.col("lang").alias("short_answer"))
    return Q.normalise_absqa(d, "documents").select("id", "task", "question", "answer")


@query("normalise_extqa", "SELECT CAST(doc_id AS VARCHAR) AS id, 'extqa' AS task, lang AS question, source AS answer, CAST(doc_id AS BIGINT) AS answer_start FROM documents")
def normalise_extqa(spark, sf_dir):
    """G2."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("question"), F.col("text").alias("context"), F.struct(F.array("source").alias("text"), F.array("doc_id").alias("answer_start")).alias("answers"))
    return Q.normalise_extqa(d).select("id", "task", "question", "answer", F.col("answer_meta.answer_start").alias("answer_start"))


@query("validation_gates", "SELECT CAST(p_partkey AS VARCHAR) AS id, 'letters' AS rule FROM part WHERE p_size % 3 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'answer' FROM part WHERE p_size % 3 = 1 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'letters' FROM part WHERE p_size % 3 = 1")
def validation_gates(spark, sf_dir):
    """Broken rules with their rows."""
    rows = Q.normalise_mcqa(_qa(spark, sf_dir), "part").withColumn("k", F.col("id").cast("long")).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size"), "k")
    rows = rows.withColumn("answer", F.when(F.col("p_size") % 3 == 0, "a").when(F.col("p_size") % 3 == 1, "").otherwise("A"))
    return Q.violations(rows).select("id", "rule")


_TAGS = "[CASE WHEN i % 5 = 0 THEN 'B-DISO' WHEN i % 5 IN (1, 2) AND doc_id % 2 = 0 THEN 'I-DISO' ELSE 'O' END for i in range(0, len(tokens))]"


@query("entity_spans", f"""
WITH s AS (SELECT doc_id, string_split(lang || ' ' || source || ' a bb ccc d ee f', ' ') AS tokens FROM documents), t AS (SELECT doc_id, tokens, unnest(range(0, len(tokens), 5)) AS first FROM s),
e AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN least(first + 2, len(tokens) - 1) ELSE first END AS last FROM t)
SELECT doc_id AS id, 'DISO' AS kind, first, last, array_to_string(tokens[first + 1 : last + 1], ' ') AS answer, CAST(CASE WHEN first = 0 THEN 0 ELSE length(array_to_string(tokens[1 : first], ' ')) + 1 END AS BIGINT) AS start FROM e
""")
def entity_spans(spark, sf_dir):
    """Entities of BIO tags with character offsets."""
    return spans_result(Q.entity_spans(tagged_sentences(spark, sf_dir)))


def tagged_sentences(spark, sf_dir):
    tokens = F.split(F.concat_ws(" ", "lang", "source", F.lit("a bb ccc d ee f")), " ")
    tag = lambda t, i: F.when(i % 5 == 0, "B-DISO").when((i % 5).isin(1, 2) & (F.col("doc_id") % 2 == 0), "I-DISO").otherwise("O")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sent_id"), tokens.alias("tokens"), F.transform(tokens, tag).alias("tags"))


def spans_result(spans):
    return spans.select("id", "kind", *[F.col(c).cast("long").alias(c) for c in ("first", "last")], "answer", F.col("start").cast("long").alias("start"))


@query("entity_questions", "SELECT concat('ner_', doc_id, '_', f) AS id, 'extqa' AS task, q AS question, concat(lang, ' ', source, ' x') AS context, CASE WHEN f = 0 THEN concat(lang, ' ', source) ELSE 'x' END AS answer FROM documents, (VALUES (0, 'Quelle pathologie ou trouble est mentionné ?'), (2, 'Quel composé chimique ou médicament est mentionné ?')) v(f, q)")
def entity_questions(spark, sf_dir):
    """G4 to QA rows, whole."""
    tags = F.array(F.lit("B-DISO"), F.lit("I-DISO"), F.lit("B-CHEM"))
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sent_id"), F.array("lang", "source", F.lit("x")).alias("tokens"), tags.alias("tags"))
    return Q.spans_to_extqa(Q.entity_spans(s), "ner").select("id", "task", "question", "context", "answer")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("chat_render", f"SELECT p_partkey, md5('<|im_start|>system' || chr(10) || {_sql(X.SYSTEM)} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {_sql(X.MCQA)} || chr(10) || chr(10) || 'Question: ' || p_name || chr(10) || chr(10) || 'A) ' || p_brand || chr(10) || 'B) ' || p_type || chr(10) || chr(10) || 'Réponse:<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || 'A<|im_end|>' || chr(10)) AS chat_md5 FROM part")
def chat_render(spark, sf_dir):
    """T10, T12, T15, T16."""
    rows = Q.normalise_mcqa(_qa(spark, sf_dir), "part").withColumn("answer", F.lit("A"))
    chat = X.chat_ml(X.task_messages("task", "question", "context", "options", "answer"))
    return rows.select(F.col("id").cast("long").alias("p_partkey"), F.md5(chat).alias("chat_md5"))


def _turn(role: str, content: str) -> str:
    return f"'<|im_start|>{role}' || chr(10) || {content} || '<|im_end|>' || chr(10)"


_SHOT = lambda q, a: _turn("user", f"{_sql(X.ABSQA)} || chr(10) || chr(10) || 'Question: {q}' || chr(10) || chr(10) || 'Réponse en français:'") + " || " + _turn("assistant", f"'{a}'")
_EXT = f"{_sql(X.EXTQA)} || chr(10) || chr(10) || 'Texte:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || source || chr(10) || chr(10) || 'Réponse (passage exact, court):'"


@query("few_shot_prompts", f"SELECT doc_id, CAST(6 AS INT) AS turns, md5({_turn('system', _sql(X.SYSTEM))} || {_SHOT('Q1', 'A1')} || {_SHOT('Q2', 'A2')} || {_turn('user', _EXT)}) AS chat_md5 FROM documents")
def few_shot_prompts(spark, sf_dir):
    """Prompts with the same demos for every item."""
    d = table(spark, sf_dir, "documents")
    demos = F.array(*[F.struct(X.absqa_prompt(F.lit(q), F.lit(None)).alias("prompt"), F.lit(a).alias("answer")) for q, a in (("Q1", "A1"), ("Q2", "A2"))])
    ext = X.build_messages(X.extqa_prompt("text", "source"), demos)
    return d.select("doc_id", F.size(ext).alias("turns"), F.md5(X.chat_ml(ext)).alias("chat_md5"))
