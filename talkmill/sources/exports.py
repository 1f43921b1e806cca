"""Conversation exports: JSON files to one row per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators.extract import NOT_AN_OBJECT
from talkmill.operators.long_values import is_long, long_items
from talkmill.sources.arrays import LIST, VALUE, json_segments

MALFORMED = "malformed_json"


def read_export_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source_file, value`` of every ``*.json`` file directly under ``path``.

    For streams of small files; ``read_exports`` splits large ones.
    """
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("source_file"), "value")


# Names of files taken as JSON documents, and as JSON Lines.
FILES_PATTERN = "*.json"
LINES_PATTERN = "*.{json,jsonl,ndjson,jsonl.gz}"


def read_export_lines(
    spark: SparkSession, path: str | list[str], pattern: str = LINES_PATTERN
) -> DataFrame:
    """``source_file, pos, conversation, reject`` of JSON Lines files, which Spark splits.

    Positions are unique and grow along each split, so that no file has to be
    gathered in one task to number it; they are not consecutive.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    return lines.filter(F.length(F.trim("value")) > 0).select(
        F.col("_metadata.file_name").alias("source_file"),
        (F.monotonically_increasing_id() + 1).alias("pos"),
        F.col("value").alias("conversation"),
        F.when(F.try_parse_json("value").isNull(), MALFORMED).alias("reject"),
    )


def _items(value: Column) -> Column:
    """``(raw, is_object)`` of each conversation in a file's text.

    A list item that is a string may hold the text of an object.  Reading the
    list as objects fails if any item is not one; only then are types looked at.
    """
    raw = F.from_json(value, "array<string>")
    all_objects = F.from_json(value, "array<struct<__none:string>>").isNotNull()
    types = F.transform(
        F.from_json(value, "array<variant>"),
        lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)),
    )
    flags = F.when(all_objects, F.transform(raw, lambda _: F.lit(True))).otherwise(
        F.coalesce(types, F.transform(raw, lambda r: F.json_object_keys(r).isNotNull()))
    )
    items = F.arrays_zip(raw.alias("raw"), flags.alias("is_object"))
    return F.when(is_long(value), long_items(value)).otherwise(items)


def _one(raw: Column, is_object: bool) -> Column:
    return F.array(F.struct(raw.alias("raw"), F.lit(is_object).alias("is_object")))


_WHITE = " \t\r\n"
_NONE = "struct<raw:string,is_object:boolean>"


def _of_value(v: Column) -> Column:
    """Items of a trimmed JSON value: a list's own, an object itself, none of any other; null if it is no JSON."""
    a_list = F.startswith(v, F.lit("[")) & F.endswith(v, F.lit("]"))
    an_object = F.startswith(v, F.lit("{")) & F.endswith(v, F.lit("}"))
    scalar = ~F.startswith(v, F.lit("[")) & ~F.startswith(v, F.lit("{")) & (
        F.try_parse_json(v).isNotNull()
    )
    return (
        F.when(a_list, _items(v))
        .when(an_object & (is_long(v) | F.json_object_keys(v).isNotNull()), _one(v, True))
        .when(scalar, F.array_compact(F.array(F.lit(None).cast(_NONE))))
    )


def _rows(items: DataFrame) -> DataFrame:
    """``source_file, pos, conversation, reject`` from ``source_file, before, items``; a row without items is one reject."""
    unread = F.array(
        F.struct(F.lit(None).cast("string").alias("raw"), F.lit(None).cast("boolean").alias("is_object"))
    )
    rows = items.select(
        "source_file", "before", F.posexplode(F.coalesce("items", unread)).alias("pos", "item")
    )
    reason = F.when(F.col("item.is_object").isNull(), MALFORMED).when(
        ~F.col("item.is_object"), NOT_AN_OBJECT
    )
    return rows.select(
        "source_file",
        (F.col("before") + F.col("pos") + 1).cast("bigint").alias("pos"),
        F.col("item.raw").alias("conversation"),
        reason.alias("reject"),
    )


def split_files(files: DataFrame) -> DataFrame:
    """``source_file, pos, conversation, reject`` from ``source_file, value``.

    A list gives its items, an object itself, any other JSON value nothing.  A
    file that is no JSON gives one rejected row without a conversation.
    """
    found = _of_value(F.btrim("value", F.lit(_WHITE)))
    return _rows(files.select("source_file", F.lit(0).alias("before"), found.alias("items")))


def split_segments(segments: DataFrame) -> DataFrame:
    """As ``split_files``, from the segments that large files are read in.

    Each segment is read by itself: one that is no JSON is a rejected row, and the rest of its file is kept.
    """
    v = F.btrim("record", F.lit(_WHITE))
    first = F.col("segment") == 0
    opened = F.startswith(v, F.when(first, "[").otherwise(","))
    closes = F.endswith(v, F.lit("]"))
    body = F.substring(v, F.lit(2), F.char_length(v) - F.when(closes, 2).otherwise(1))
    blank = F.btrim(body, F.lit(_WHITE)) == ""
    none = F.array_compact(F.array(F.lit(None).cast(_NONE)))
    of_list = (
        F.when(~first & (v == "]"), none)
        .when(opened & blank & first & closes, none)
        .when(opened & ~blank, _items(F.concat(F.lit("["), body, F.lit("]"))))
    )
    found = F.when(F.col("kind") == LIST, of_list).when(F.col("kind") == VALUE, _of_value(v))
    before = F.when((F.col("kind") == LIST) & ~first, F.col("base") + 1).otherwise(0)
    return _rows(segments.select("source_file", before.alias("before"), found.alias("items")))


def read_exports(
    spark: SparkSession, path: str | list[str], *, lines: bool = False, spread: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """``source_file, pos, conversation, reject`` of all exports under ``path``.

    A large file is read by many tasks.  ``spread`` hands conversations out to that many tasks before the costly work, which
    pays where single conversations are large.
    """
    if lines:
        rows = read_export_lines(spark, path, pattern or LINES_PATTERN)
    else:
        rows = split_segments(json_segments(spark, path, pattern or FILES_PATTERN))
    return rows.repartition(spread) if spread else rows
