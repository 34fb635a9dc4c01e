"""Time the headline queries over $BENCH_SF_DIR and print one JSON line.

Every query runs to the end into a no-op sink, so all of its rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanweave.session import build_session  # noqa: E402
from workload.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "tokenize_offsets", "lexicon_flag", "subtitle_findings", "subtitle_findings_precise", "whisper_hits",
    "merge_spans", "keep_intervals", "window_overlap", "coverage_ms", "nearest_finding",
    "worst_sample_per_shot", "scene_findings", "plan_verdict_join", "sample_times",
    "merge_reanalysis", "apply_edits", "merge_into_one", "headline_job", "status_for_paths", "library_view", "queue_rank",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=cpus, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        # One file per table: small splits let every core scan it.
        "spark.sql.files.maxPartitionBytes": "4m"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor before the clock does
    names = sys.argv[1:] or HEADLINE
    took = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - started, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
