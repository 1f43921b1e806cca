"""Language identification with a store of earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.functions.language import identify
from talkmill.sources.store import read_store

STORE_SCHEMA = "text_hash string, language string"


def known_languages(df: DataFrame, store: str) -> DataFrame:
    """``text_hash, language`` kept so far, one row per hash."""
    rows = read_store(df.sparkSession, store, STORE_SCHEMA)
    return rows.groupBy("text_hash").agg(F.min("language").alias("language"))


def misses(hashed: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """``text_hash, prefix`` of each distinct text without a kept result.

    Hashes alone are compared first; only prefixes whose hash is missing move.
    """
    missing = hashed.select("text_hash").distinct().join(known.select("text_hash"), "text_hash", "left_anti")
    return (
        hashed.select("text_hash", T.detection_prefix(text).alias("prefix"))
        .join(missing, "text_hash", "left_semi")
        .groupBy("text_hash")
        .agg(F.any_value("prefix").alias("prefix"))
    )


def identify_cached(
    df: DataFrame, profiles: dict[str, list[str]], store: str, text: str = "text"
) -> DataFrame:
    """Add ``text_hash`` and ``language``, keeping every result in ``store``.

    Each distinct text is identified once, also across runs.  This pays off for
    many copies or a costly detector; ``identify`` alone needs no shuffle at all.
    """
    hashed = df.withColumn("text_hash", T.text_hash(text))
    new = misses(hashed, known_languages(df, store), text).select(
        "text_hash", identify("prefix", profiles).alias("language")
    )
    new.write.mode("append").parquet(store)
    return hashed.join(known_languages(df, store), "text_hash", "left")
