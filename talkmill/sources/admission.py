"""Rules an upload must meet; off for cluster runs unless asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkmill.sources.store import shared_folder

# Limits of an upload.
EXTENSIONS = ["json", "csv"]
MAX_FILES = 20
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_TOTAL_BYTES = 50 * 1024 * 1024

TOO_MANY = "too_many_files"
UNSUPPORTED = "unsupported_type"
FILE_TOO_LARGE = "file_too_large"
TOTAL_TOO_LARGE = "total_too_large"


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``name, bytes`` of files; their content is not read."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes")
    )


def admission(
    files: DataFrame,
    *,
    max_files: int = MAX_FILES,
    max_file_bytes: int = MAX_FILE_BYTES,
    max_total_bytes: int = MAX_TOTAL_BYTES,
) -> DataFrame:
    """``name, bytes, running_bytes, problem`` of every file.

    Names are dealt into ranges; a range's running total starts from the sum of the ranges before it, so only
    one row for each range meets in one place.  The ranges are written down, as both steps must see the same.
    """
    spark = files.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_folder(spark, "listing")
    dealt = files.select("name", "bytes").repartitionByRange(ranges, "name", "bytes")
    dealt.withColumn("part", F.spark_partition_id()).write.parquet(folder)
    listed = spark.read.schema("name string, bytes bigint, part int").parquet(folder)
    sums = listed.groupBy("part").agg(F.sum("bytes").alias("sum"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("name", "bytes").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    too_many = listed.count() > max_files
    extension = F.lower(F.regexp_extract(F.trim("name"), r".\.([^.]*)$", 1))
    rows = listed.join(starts, "part").withColumn(
        "running_bytes", F.col("start") + F.sum("bytes").over(inside)
    )
    return rows.select(
        "name",
        "bytes",
        "running_bytes",
        F.when(F.lit(too_many), TOO_MANY)
        .when(~extension.isin(EXTENSIONS), UNSUPPORTED)
        .when(F.col("bytes") > max_file_bytes, FILE_TOO_LARGE)
        .when(F.col("running_bytes") > max_total_bytes, TOTAL_TOO_LARGE)
        .alias("problem"),
    )


def check(files: DataFrame, **limits: int) -> list[str]:
    """Names of the admitted files, or ``ValueError`` with the first problem."""
    rows = admission(files, **limits).collect()
    if not rows:
        raise ValueError("no files")
    for r in sorted(rows, key=lambda r: (r["name"], r["bytes"])):
        if r["problem"]:
            raise ValueError(f"{r['problem']}: {r['name']}")
    return [r["name"] for r in rows]
