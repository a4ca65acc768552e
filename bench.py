"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from brindle.plans.catalogue import QUERIES

HEADLINE = [
    "harvest_budget", "clean_length_gate", "harvest_funnel", "exact_dup_keep_first", "shingle_jaccard_pairs", "minhash_dedup", "leakage_filter", "leakage_containment", "unigram_ppl", "dsir_topk", "curriculum_buckets",
    "replay_interleave", "task_stats", "cosine_knn", "exact_match", "token_f1", "rouge_bleu", "mcqa_cells", "error_taxonomy", "consensus", "duel_rollup", "paired_stats", "paired_tests", "bh_fdr", "friedman_stat", "seed_summary", "judge_parse",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["harvest_funnel"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
