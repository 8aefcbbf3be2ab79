"""Headline timings: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the tables and threads.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from querywarden.operators.evaluation import run_evaluation  # noqa: E402
from querywarden.operators.keyword import keyword_scan  # noqa: E402
from querywarden.operators.policy import check_boundaries  # noqa: E402
from querywarden.operators.verdict import score  # noqa: E402
from querywarden.plans.queries import REGISTRY, _corpus  # noqa: E402
from querywarden.plans.querylog import query_log, texts  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPORTS = (
    "fused_actions", "keyword_risk", "rule_hit_counts", "gold_join", "policy_quarantine", "split", "ablation",
    "detection_by_attack", "security_metrics", "overfit_gap", "entropy", "cosine_alignment", "stream_guard",
)


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    log = query_log(spark, SF_DIR)
    docs = texts(spark, SF_DIR, "documents")
    runs = {
        "verdict_all_columns": lambda: consume(score(log)),
        "verdict_action": lambda: consume(score(log).select("id", "action")),
        "policy_strict": lambda: consume(check_boundaries(log)),
        "keyword_scan": lambda: consume(keyword_scan(log)),
        "documents_scan": lambda: consume(keyword_scan(docs, "text").select("doc_id", "matched_rules")),
        "evaluation_end_to_end": lambda: consume(run_evaluation(_corpus(spark, SF_DIR)).report),
    }
    runs |= {name: lambda name=name: consume(REGISTRY[name](spark, SF_DIR)) for name in REPORTS}
    consume(log)
    seconds = {}
    for name, run in runs.items():
        run()  # once to compile and read the files; the second run counts
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    rows, size = log.count(), docs.selectExpr("sum(octet_length(text))").first()[0]
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "rows_per_sec": {
                    name: round(rows / seconds[name]) for name in ("verdict_all_columns", "verdict_action", "policy_strict", "keyword_scan")
                },
                "documents_mb_per_sec": round(size / 1e6 / seconds["documents_scan"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
