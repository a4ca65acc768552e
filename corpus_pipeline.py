"""The corpus pipeline: language ID, n-gram Jaccard join, substring dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs; all but the last return
the columns of `documents`.  Extra columns of any name pass through; the operators read only doc_id,
text and lang.  A row is known by its doc_id and text: rows that share a doc_id are judged each by its
own text, rows that agree in both are one document to a stage.  Null ids are ids like others and come
last where the smallest is chosen.  An empty table passes every stage without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.decontam import decontaminate
from brindle.llm.language import UNDETERMINED, fit, label
from brindle.llm.ngram_join import keep_representatives
from brindle.llm.packing import pack
from brindle.llm.substring import dedup_substrings, text_key
from brindle.sources.scratch import lean_batches, shared_if_small, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text or no letter) go; `lang` becomes the predicted language."""
    lean_batches(spark)
    found = label(docs, fit(docs)).filter(F.col("__lang_pred") != UNDETERMINED)
    return found.withColumn("lang", F.col("__lang_pred")).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates stays, that of the smallest doc_id; of equal rows one stays.  Rows without words stay."""
    return keep_representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines, paragraphs and passages go, all but their first occurrence; documents of which nothing is left go."""
    lean_batches(spark)
    names = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    found = dedup_substrings(docs.withColumnsRenamed(names), min_line=1, whole_passages=True, carry=tuple(names.values()))
    left = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    left = left.select("doc_id", "text", *[F.col(v).alias(c) for c, v in names.items()])
    return (left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else left).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a benchmark phrase go; other rows of the same doc_id stay."""
    hit = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("hit") > 0).select(F.col("doc_id").alias("__hit"), F.col("key").alias("__key")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__hit")) & (text_key(F.col("text").cast("string")) == F.col("__key"))
    return docs.join(shared_if_small(stored(hit, "contaminated"), 24), same, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Trained bits, chosen passages and token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}-{name}")
    return docs
