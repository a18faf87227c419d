"""Times the headline queries and prints one JSON line.

Each query runs to completion twice without collecting rows; the faster run counts.  The stored tables
the queries start from are derived once, timed apart as ``setup_sec``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lorekeep.session import build_session
from workload.base import captures, insights, solutions
from workload.queries import ALL_CAPTURES, QUERIES
from workload import inputs

HEADLINE = (
    "solutions_search",
    "list_solutions",
    "count_solutions",
    "search_or_exists",
    "import_solutions",
    "import_summary",
    "create_solutions",
    "update_solutions",
    "delete_solutions",
    "insert_captures",
    "list_captures",
    "clear_unanalyzed",
    "upsert_insights",
    "promote_captures",
    "double_trigger",
    "double_chord",
    "recent_ring_throttle",
    "capture_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    start = time.perf_counter()
    for table in (solutions, captures, insights):
        table(spark, sf_dir).count()
    setup = time.perf_counter() - start

    seconds: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = round(time.perf_counter() - start, 3)
            seconds[name] = min(took, seconds.get(name, took))
    result = {
        "metric": "headline queries, best of two runs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "setup_sec": round(setup, 3),
    }
    if "capture_stream" in seconds:
        rows = inputs.view(spark, sf_dir, ALL_CAPTURES).count()
        result["capture_stream_rows_per_sec"] = round(rows / seconds["capture_stream"])
    print(json.dumps(result))


if __name__ == "__main__":
    main()
