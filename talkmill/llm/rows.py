"""Row identity for tables that may repeat ids, leave them null, or carry columns of any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """One string per (id, text); rows that repeat both share it, and it is never null."""
    number = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.concat(number, F.lit(":"), F.hex(F.xxhash64(text_or_empty(text_col))))


def narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), text never null: no other column can clash with those an operator adds."""
    return df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))


def read_docs(spark, sf_dir: str) -> DataFrame:
    return narrow(spark.read.parquet(f"{sf_dir}/documents.parquet"))
