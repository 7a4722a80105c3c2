"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "q_normalize_text", "q_ngrams", "q_rarity_tfidf", "q_search_plain", "q_links_blocked", "q_dedup_documents", "q_exact_dedup",
    "q_embedding_links", "q_resolve_entities", "q_plan_frontier", "q_aip",
]


def main() -> None:
    from linkwright.plans.runtime import build_session

    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    from linkwright.plans.catalog import QUERIES

    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("sum(length(text))").collect()  # starts the JVM's readers
    took = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
