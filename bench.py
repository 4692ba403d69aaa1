"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_QUERIES a
comma-separated choice of queries.  Each query is run BENCH_ROUNDS times and
the best time counts; every result row is computed and thrown away.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from inkveil.plans.layout import INPUT_PARTITIONS, configured
from inkveil.plans.workload import registered

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = int(os.environ.get("BENCH_ROUNDS", "3"))
HEADLINE = (
    "redact_label,redact_box,detect_counts,corpus_detect_totals,redact_label_dense,"
    "redact_box_dense,keyword_redact,custom_regex_redact,custom_regex_python,extract_html,"
    "redact_sources,output_names,output_names_existing,last_write_wins,dedup_inputs,run_progress,"
    "write_outputs,activity_log,redact_stream_named,scan_preview"
)


def main() -> None:
    spark = (
        configured(SparkSession.builder.master(f"local[{CPUS}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        # The tables are single row groups, which one task would read.
        .config(INPUT_PARTITIONS, str(2 * int(CPUS)))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = registered()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", HEADLINE).split(","):
        times = []
        for _ in range(ROUNDS):
            start = time.perf_counter()
            every[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)/?$", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_best_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale[1]) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
