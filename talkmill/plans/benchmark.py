"""Timing of the jobs' actions."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from talkmill.operators.embed import Encoder
from talkmill.plans import jobs


def time_stage(name: str, build: Callable[[], DataFrame]) -> dict[str, object]:
    """Seconds, rows and rows per second to produce every row and column of a result."""
    seen = Observation(name)
    start = time.monotonic()
    rows = build().observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.format("noop").mode("overwrite").save()
    seconds = time.monotonic() - start
    n = seen.get["rows"]
    return {
        "stage": name,
        "seconds": round(seconds, 3),
        "rows": n,
        "rows_per_second": round(n / seconds, 1),
    }


def job_stages(
    spark: SparkSession, exports: str, output: str, encoder: Encoder | None = None, **source
) -> dict[str, Callable[[], DataFrame]]:
    """Ingest, embed and categorize, each on what the one before has written under ``output``; ``source`` goes to the ingest."""
    return {
        "ingest": lambda: jobs.run_ingest(spark, exports, f"{output}/ingest", **source).clean,
        "embed": lambda: jobs.run_embed(
            spark, spark.read.parquet(f"{output}/ingest/clean"), f"{output}/store", f"{output}/vectors", encoder
        ),
        "categorize": lambda: jobs.run_categorize(
            spark, spark.read.parquet(f"{output}/ingest/clean"), f"{output}/categorize"
        ),
    }


def run(stages: dict[str, Callable[[], DataFrame]]) -> dict[str, object]:
    """Time several stages one after the other."""
    results = [time_stage(name, build) for name, build in stages.items()]
    total = round(sum(r["seconds"] for r in results), 3)
    return {"stages": results, "total_seconds": total}


def report(spark: SparkSession, results: dict[str, object]) -> DataFrame:
    """``stage, seconds, rows, rows_per_second`` of a run, to be kept and compared with others."""
    return spark.createDataFrame(results["stages"], "stage string, seconds double, rows long, rows_per_second double")
