"""Times the headline queries, every row and column produced; prints one JSON line.

Each query runs once unmeasured, then three times; its figure is the median. Tables here are one small file each,
so the session deals them out to all cores (``spark.talkmill.deal``).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from talkmill.plans.queries import DEAL, QUERIES  # noqa: E402

RUNS = 3
HEADLINE = [
    "categorize",
    "conv_category_dist",
    "metrics_cli",
    "metrics_upload",
    "upload_rows",
    "conv_text",
    "extract_list_dialect",
    "extract_map_dialect",
    "extract_fallback",
    "category_scores",
    "language_profile",
    "language_id",
    "language_cached",
    "embed_hash",
    "embed_cached",
    "cache_misses",
    "sort_page",
    "json_lines_source",
    "embed_job",
    "categorize_job",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("talkmill-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config(DEAL, cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS + 1):
            start = time.monotonic()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.monotonic() - start)
        times[name] = round(median(taken[1:]), 3)
    spark.stop()
    result = {
        "metric": "headline queries, median of three warm runs, total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1],
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
