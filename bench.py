"""Time the headline queries and print one JSON line.

Each query is built and written to the no-op sink, so every row and column is produced.
The median of BENCH_RUNS runs counts. Names may be given as arguments; "all" takes every query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tallystar.queries import REGISTRY
from tallystar.session import build_session

HEADLINE = [
    "occupation_summary", "latest_star", "top_wages", "jobs_by_title", "chart_series",
    "rename_plan", "header_variants", "sanitize_numeric", "vintage_audit", "load_reconcile",
    "result_profile", "column_stats", "hetero_csv_read", "standardize", "warehouse_load",
    "workbook_rows", "token_sort_ratio", "fuzzy_match", "search_titles", "trace_flatten",
    "response_assembly", "mask_sensitive", "log_summary", "sql_compare", "quota_windows",
    "stream_load", "guarded_sql",
]


def run(build, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = list(REGISTRY) if names == ["all"] else names or HEADLINE
    seconds = {n: round(statistics.median(run(REGISTRY[n].build, spark, sf_dir) for _ in range(runs)), 3) for n in chosen}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
