"""Times the headline queries and prints one JSON line.

Every query runs over whole tables and is written to the noop sink, so all rows and
columns are produced.  With BENCH_REPEATS above one the best time is kept.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from quire.plans.catalog import QUERIES

HEADLINE = [
    "word_count",
    "is_page_artifact",
    "strip_html",
    "detect_structure",
    "detect_structure_manuscripts",
    "merge_paragraphs",
    "extract_citations",
    "parse_references",
    "citation_report",
    "check_references",
    "compliance_report",
    "split_sections",
    "search_and_replace",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in only.split(",") if only else HEADLINE:
        best = None
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
