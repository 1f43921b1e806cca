"""Stores kept between runs, and the folder for data a job must write down."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows kept in a store; none before the first write. An unreadable file fails the read."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that ``spark.checkpoint.dir`` names, which all executors share.

    A session without that setting gets one under its warehouse, which executors share as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{base.rstrip('/')}/talkmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, for what several steps need."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
