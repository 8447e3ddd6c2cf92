"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "kanon_token_corpus", "event_error_rollup", "rate_limit_fixed_window", "calendar_union", "interval_union_days", "interval_overlaps", "activity_gaps", "confidence_from_evidence", "score_ledger",
    "penalty_budget_double", "requirement_match", "alignment_interval", "formal_any_all", "half_life_recency", "lexeme_log_odds", "runtime_signal", "drift_report", "budgeted_lines", "round_robin_sample",
    "bounded_paths", "pagerank_fixed", "doc_encoding_quality", "html_job_cascade", "pii_scrub", "structure_score", "section_lines", "order_discordance", "telemetry_score", "role_relevance", "keyword_map",
    "phrase_log_odds", "dictionary_words", "dynamic_phrases", "truth_verdicts", "requirement_mentions", "text_blocks", "source_agreement", "unwrapped_columns", "profile_jobs", "bounded_queue",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tallyroom.plans import catalogue

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = catalogue.queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # warms the session up
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        run[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
