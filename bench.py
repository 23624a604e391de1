"""Time the headline queries on the bench data and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridsift.catalog import load_all  # noqa: E402
from gridsift.session import local_session  # noqa: E402

HEADLINE = (
    "confidence_scores", "confidence_scores_dirty", "table_shape", "distinct_counts", "type_census", "clean_cells",
    "write_tables", "parse_dates", "op_summary_rollup", "trace_rollup", "trace_steps", "debounce_events",
    "changed_only", "retry_schedule", "window_stats_5m", "output_names", "debounce_stream", "judge_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "gridsift-bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_all()
    # Warm the JVM on the smallest data, so that times compare between queries.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in ("confidence_scores", "write_tables"):
            catalog[name].run(spark, small).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "warm": os.path.isdir(small),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
