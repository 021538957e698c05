"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from plumbline.catalog import QUERIES  # noqa: E402
from plumbline.catalog.base import table  # noqa: E402
from plumbline.operators.ratios import bootstrap_ratio, coverage  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = (
    "audit_copies_per_language", "audit_duplication_top5", "audit_overlap_histogram", "audit_cross_query_repetition", "audit_score_scale",
    "topicality_gap", "layer_authority", "retrieval_scores", "summary_dominance", "label_content_groups", "rule_confusion",
    "nearest_event_within_tolerance", "bootstrap_ratio_interval", "cost_dose_check", "cosine_topk", "bm25_topk", "claim_best_threshold",
    "window_condition_matrix", "memory_copy_census", "cost_ceiling_report",
)


def interval_study(spark, sf_dir):
    """500 samples, 1000 replicates each: the customers in disjoint samples of about 30 at scale 0.1."""
    pairs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), (F.col("c_acctbal") + 2000).alias("num"), (F.col("c_nationkey") + 20).cast("double").alias("den")
    )
    return coverage(pairs, lambda d, by: bootstrap_ratio(d, by, 1000, 0.90, 7), 500)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                      "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {name: QUERIES[name] for name in HEADLINE} | {"interval_study_500x1000": interval_study}
    table(spark, sf_dir, "lineitem").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name, job in jobs.items():
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            job(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(f"{name} {runs[0]:.2f} {runs[1]:.2f}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
