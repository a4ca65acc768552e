"""Streaming curation: a file stream cleaned and gated, statelessly (the shield is in shield.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.corpus import clean_and_gate
from brindle.plans.corpus_queries import CLEAN, WORDS
from brindle.sources.scratch import new_path
from brindle.streaming.shield import file_stream, run_once

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def clean_stream(stream: DataFrame, *, low: int = 24, high: int = 2048) -> DataFrame:
    """Cleaned rows of a stream whose words lie in the gate."""
    return clean_and_gate(stream, low=low, high=high)


def run_to_table(spark: SparkSession, source: str, name: str) -> DataFrame:
    """The stream of a folder or file of Parquet, cleaned and gated once through, as a stored table."""
    out = new_path(spark, name)
    run_once(clean_stream(file_stream(spark, source)), out, new_path(spark, f"{name}-state"))
    return spark.read.parquet(out)


def stream_clean_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_table(spark, f"{sf_dir}/documents.parquet", "stream-documents").select("doc_id", "words", F.length("text").cast("long").alias("n"))


QUERIES["stream_clean_gate"] = stream_clean_gate
ORACLES["stream_clean_gate"] = f"SELECT doc_id, CAST(words AS BIGINT) AS words, CAST(length(t) AS BIGINT) AS n FROM (SELECT doc_id, t, {WORDS.format('t')} AS words FROM (SELECT doc_id, {CLEAN.format('text')} AS t FROM documents) WHERE t != '') WHERE words BETWEEN 24 AND 2048"
