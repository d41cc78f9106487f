"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once on the smallest tables before, so that class loading and
code generation are not timed.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from vigilseq.plans import reports
from vigilseq.plans.catalog import QUERIES

# The detectors run from the raw table every time; the reports read stored detections.
HEADLINES = [
    "first_alerts_with_lead",
    "n6_detect_topk",
    "n7_detect_threshold",
    "n4_event_loss_backoff",
    "n1_fit_next_event",
    "g1_with_position",
    "g2_session_sequences",
    "g9_sliding_windows",
    "g11_pack_blocks",
    "g16_gap_sessions",
    "v2_encode",
    "p13_mask_template",
    "n11_hybrid_detect",
    "l7_lead_by_category",
    "e5_threshold_sweep",
    "e8_random_baseline",
    "e11_rank_test",
    "e15_auprc",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in HEADLINES:
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    reports.topk_table(spark, folder).count()  # stored once, like the detections a report reads
    reports.threshold_table(spark, folder).count()

    spent = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)

    tested = reports.topk_table(spark, folder).count()
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": float(scale.group(1)) if scale else None,
                "detected_sessions_per_sec": round(tested / spent["n6_detect_topk"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
