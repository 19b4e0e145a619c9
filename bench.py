"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from assayer.plans import all_plans
from assayer.session import build_session

HEADLINE = (
    "token_stats",
    "chunk_documents",
    "bm25_topk",
    "bm25_scoped",
    "hash_embed_topk",
    "dense_topk",
    "rrf_hybrid",
    "lexical_rerank",
    "evidence_resolution",
    "recall_hit_at_k",
    "retriever_disagreement",
    "validation_issues",
    "grouped_split",
    "filing_selection",
    "structured_answers",
    "outcome_scores",
    "outcome_issues",
    "rewards_by_profile",
    "outcome_matrix",
    "oracle_policy",
    "weight_sensitivity",
    "bandit_log",
    "ope_errors",
    "paired_bootstrap",
    "risk_coverage",
    "agent_run_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "assayer-bench",
        cores,
        **{"spark.sql.shuffle.partitions": cores, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans, _ = all_plans()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    timings: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        plans[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        # No query may profit from what an earlier one kept.
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "total_headline_query_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
