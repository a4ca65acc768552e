"""Inputs of the catalogue's queries: the driver's tables read as the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(n: str) -> str:
    return "regexp_replace(concat(" + ", ".join(f"CASE WHEN ({n}) & {1 << i} > 0 THEN '{c},' ELSE '' END" for i, c in enumerate("ABCDE")) + "), ',$', '')"


# Expressions that both engines read alike: events as predictions and judge scores.
SHOT = "CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 5 END"
ITEM_COLUMNS = {
    "model": "event_type", "n_shot": f"CAST({SHOT} AS INT)", "item": "user_id", "pos": "event_id", "n_choices": "CAST(5 AS INT)",
    "pred": _letters("(event_id * 7 + user_id * 5) % 32"), "gold": _letters("user_id % 31 + 1"), "raw": "concat('Réponse: ', " + _letters("(event_id * 3 + user_id) % 32") + ")",
}
SCORE_COLUMNS = {
    "judge": "concat('j', CAST(event_id % 2 AS STRING))", "model": "event_type", "n_shot": f"CAST({SHOT} AS INT)", "item": "user_id", "pos": "event_id",
    "axis": "CASE (event_id * 13 + user_id) % 4 WHEN 0 THEN 'factual' WHEN 1 THEN 'complete' WHEN 2 THEN 'relevance' ELSE 'safety' END",
    "score": "CAST(1 + (event_id * 31 + user_id * 17) % 5 AS DOUBLE)",
}
DUEL_COLUMNS = {
    "judge": "concat('j', CAST(event_id % 2 AS STRING))", "challenger": "event_type", "n_shot": f"CAST({SHOT} AS INT)", "item": "user_id",
    "verdict_ab": "CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'TIE' WHEN 3 THEN 'A' ELSE NULL END",
    "verdict_ba": "CASE (event_id * 3 + user_id) % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN 'TIE' WHEN 3 THEN 'B' ELSE NULL END",
}


def _select(columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM events"


ITEMS_SQL, SCORES_SQL, DUELS_SQL = map(_select, (ITEM_COLUMNS, SCORE_COLUMNS, DUEL_COLUMNS))


def _events(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, ITEM_COLUMNS)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, SCORE_COLUMNS)


def duels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, DUEL_COLUMNS)


#: One score for each (model, shots, item), the mean of its events.
CELL_SCORES_SQL = f"SELECT model, n_shot, item, avg(score) AS score FROM ({SCORES_SQL}) GROUP BY model, n_shot, item"


def cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return scores(spark, sf_dir).groupBy("model", "n_shot", "item").agg(F.avg("score").alias("score"))


#: A user turn and the assistant turn after it, as gold and prediction.
TURN_PAIRS_SQL = "SELECT a.conv_id, a.turn, a.text AS gold, b.text AS pred FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = table(spark, sf_dir, "conversations")
    user = rows.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("gold"))
    answer = rows.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return user.join(answer, ["conv_id", "turn"])
