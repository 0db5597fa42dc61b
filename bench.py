"""Benchmark: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion with the ``noop`` sink (full execution, no
collect to the driver). The first query also pays JVM warm-up; a warm-up run
of a small query happens before timing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "feature_table",
    "prior_customer_history",
    "price_percentile",
    "product_label_index",
    "audit_chain",
    "audit_verify",
    "run_history",
    "column_profile",
    "relationship_candidates",
    "scorecard_overall",
    "temporal_split",
    "baseline_class_report",
    "transform_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from kestrel.session import build_session
    spark = build_session(cpus=cpus, shuffle_partitions=max(8, cpus * 2), app_name="kestrel-bench")
    from kestrel.plans.registry import all_queries
    qs = all_queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    # JIT warm-up on the smallest scale (same code paths), then timed runs
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        qs["feature_table"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
