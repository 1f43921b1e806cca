"""CSV sources and the sinks of the jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.sources.quoted import FILE, HEADER, ROW, read_quoted

# CSV fields that mean "no value".
NA_VALUES = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

CLEAN_COLUMNS = ["conversation_id", "text", "language", "source_file"]

_CSV = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _value(name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.when(~c.isin(NA_VALUES), c).alias(name)


def _read(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, list[list[str]]]:
    rows, names = read_quoted(spark, paths, _CSV)
    own = (FILE, ROW, HEADER)
    return rows.select(*[_value(c) for c in rows.columns if c not in own], *own), names


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV files with every field as text and pandas' null spellings as null, and the file's name in ``__file``.

    Files may differ in their columns. Large files are read by many tasks, line breaks in fields or not.
    """
    return _read(spark, paths)[0].drop(ROW, HEADER)


def _require_text(df: DataFrame) -> DataFrame:
    if "text" not in df.columns:
        raise ValueError(f"no 'text' among the columns {df.columns}")
    return df


def csv_for_categorize(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows to categorize: all columns; rows without text are left out."""
    return _require_text(read_csv(spark, paths)).drop(FILE).filter(F.col("text").isNotNull())


def csv_for_embed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows to embed: all columns; rows without text or with blank text are left out."""
    df = _require_text(read_csv(spark, paths)).drop(FILE)
    return df.filter(F.col("text").isNotNull() & ~T.is_blank("text"))


def upload_csv_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Clean rows of uploaded CSV files; none of a file without a text column.

    A missing id column gives ``row_<position>``, a missing language ``unknown``;
    an empty field in either becomes the text ``nan``.
    """
    df, names = _read(spark, path)
    if "text" not in df.columns:
        schema = ", ".join(f"{c} string" for c in CLEAN_COLUMNS)
        return spark.createDataFrame([], schema)

    def given(column: str, otherwise: Column) -> Column:
        with_it = [k for k, own in enumerate(names) if column in own]
        if not with_it:
            return otherwise
        return F.when(F.col(HEADER).isin(with_it), F.coalesce(column, F.lit("nan"))).otherwise(otherwise)

    numbered = F.concat(F.lit("row_"), F.col(ROW).cast("string"))
    return df.filter(F.col("text").isNotNull() & ~T.is_blank("text")).select(
        given("conversation_id", numbered).alias("conversation_id"),
        "text",
        given("language", F.lit("unknown")).alias("language"),
        F.col(FILE).alias("source_file"),
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write with header; quotes are doubled and white space is kept."""
    df.write.mode(mode).options(**_CSV, header=True, encoding="UTF-8", emptyValue="").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a report, a single row, as JSON."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a relation for later steps."""
    df.write.mode(mode).parquet(path)
