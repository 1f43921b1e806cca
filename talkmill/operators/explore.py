"""Searching, filtering, sorting and paging categorized rows."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talkmill.functions import text as T

SEARCHED = ["text_preview", "conversation_id", "main_category"]
PAGE_SIZE = 25
RANGE = "__range"

# Our bins: no hit, then up to each edge; the last cut is the high-confidence cut doubled.
CONFIDENCE_BINS = [(0, "0"), (2, "1-2"), (5, "3-5"), (10, "6-10")]
LAST_BIN = ">10"


def search(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any of the columns contains the query, in any case."""
    needle = F.lower(F.lit(query))
    tests = [
        F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), needle)
        for c in columns or SEARCHED
    ]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return df.filter(found)


def filter_category(df: DataFrame, category: str) -> DataFrame:
    return df.filter(F.col("main_category") == category)


def category_options(df: DataFrame) -> DataFrame:
    """The categories that occur, for a filter to choose from."""
    return df.select("main_category").distinct().orderBy("main_category")


def filter_complexity(df: DataFrame, complexity: str) -> DataFrame:
    return df.filter(F.col("complexity") == complexity)


def _sort_value(column: str) -> Column:
    return T.complexity_rank(column) if column == "complexity" else F.col(column)


def sort_rows(
    df: DataFrame, column: str, *, descending: bool = False, tie: str = "conversation_id"
) -> DataFrame:
    """Rows by one column, then by id; complexity sorts from simple to complex."""
    value = _sort_value(column)
    return df.orderBy(value.desc() if descending else value.asc(), F.col(tie))


def page(
    df: DataFrame,
    column: str,
    *,
    number: int = 0,
    size: int = PAGE_SIZE,
    descending: bool = False,
    tie: str = "conversation_id",
) -> DataFrame:
    """One page of the sorted rows, counted from 0.

    Every task keeps only the rows up to the page's end.  For pages far in,
    ``page_after`` keeps one page per task instead.
    """
    rows = sort_rows(df, column, descending=descending, tie=tie)
    return rows.offset(number * size).limit(size)


def page_after(
    df: DataFrame,
    column: str,
    last_value: object,
    last_id: object,
    *,
    size: int = PAGE_SIZE,
    descending: bool = False,
    tie: str = "conversation_id",
) -> DataFrame:
    """The page after a known last row, whose sort value must not be null."""
    value, last = _sort_value(column), F.lit(last_value)
    if column == "complexity":
        last = T.complexity_rank(last)
    further = value < last if descending else value > last
    if descending:
        further = further | value.isNull()
    same = (value == last) & (F.col(tie) > F.lit(last_id))
    return sort_rows(df.filter(further | same), column, descending=descending, tie=tie).limit(
        size
    )


@dataclass(frozen=True)
class Pages:
    """Rows kept in ranges of the sort order, with the number of rows in each; any page is read from the ranges it lies in."""

    path: str
    order: tuple[str, bool, str]
    before: list[int]
    schema: StructType
    spark: SparkSession

    @staticmethod
    def build(df: DataFrame, column: str, path: str, *, descending: bool = False, tie: str = "conversation_id", ranges: int | None = None) -> Pages:
        """Sort ``df`` once into ``path``.  One number for each range comes to the driver."""
        spark = df.sparkSession
        count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        value = _sort_value(column)
        key = [value.desc() if descending else value.asc(), F.col(tie).asc()]
        dealt = df.repartitionByRange(count, *key).withColumn(RANGE, F.spark_partition_id())
        dealt.sortWithinPartitions(RANGE, *key).write.partitionBy(RANGE).parquet(path)
        sizes = dict(spark.read.schema(dealt.schema).parquet(path).groupBy(RANGE).count().collect())
        before = list(accumulate((sizes.get(k, 0) for k in range(count)), initial=0))
        return Pages(path, (column, descending, tie), before, dealt.schema, spark)

    def page(self, number: int = 0, size: int = PAGE_SIZE) -> DataFrame:
        """The rows that ``page`` of the whole would give."""
        first, end = number * size, (number + 1) * size
        touched = [k for k in range(len(self.before) - 1) if self.before[k] < end and self.before[k + 1] > first]
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        if not touched:
            return rows.drop(RANGE).limit(0)
        column, descending, tie = self.order
        some = rows.filter(F.col(RANGE).isin(touched)).drop(RANGE)
        skipped = max(first - self.before[touched[0]], 0)
        return sort_rows(some, column, descending=descending, tie=tie).offset(skipped).limit(end - max(first, self.before[touched[0]]))


def confidence_histogram(df: DataFrame) -> DataFrame:
    """Rows per confidence bin that occurs."""
    c = F.col("confidence_score")
    label = F.when(c <= CONFIDENCE_BINS[0][0], CONFIDENCE_BINS[0][1])
    for edge, name in CONFIDENCE_BINS[1:]:
        label = label.when(c <= edge, name)
    return (
        df.groupBy(label.otherwise(LAST_BIN).alias("bin"))
        .agg(F.count(F.lit(1)).alias("conversations"))
    )
