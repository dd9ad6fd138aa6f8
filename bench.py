"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

One warm-up, then the median of BENCH_RUNS runs (3); every result is forced by a write to the noop sink, so nothing
is collected. BENCH_QUERIES picks other registered queries by prefix, `all` takes every one.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opslens.plans import QUERIES  # noqa: E402
from opslens.session import build_session  # noqa: E402

HEADLINE = (
    "u15_usage_summary", "u17_account_usage_buckets", "c02_dedup_captures", "c05_cap_per_bucket", "i07_resolve_context",
    "i11_plan_entities_projects", "r01_decide_phase1", "l02_unprocessed", "j01_job_snapshot", "j06_overlap_profile",
    "a08_skip_dependents", "a09_weighted_score", "a14_aggregate", "x01_extract_proposal", "m01_html_to_text",
)


def chosen() -> list[str]:
    wanted = os.environ.get("BENCH_QUERIES", "")
    if not wanted:
        return list(HEADLINE)
    if wanted == "all":
        return list(QUERIES)
    return [q for q in QUERIES if any(q.startswith(p) for p in wanted.split(","))]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in chosen():
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 4)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main()
