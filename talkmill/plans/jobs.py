"""The whole jobs: ingest, embed, categorize, and the upload analysis."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.functions.language import UNKNOWN, identify, sample_model
from talkmill.functions.taxonomy import DEFAULT, Taxonomy
from talkmill.operators import categorize as C
from talkmill.operators import embed as E
from talkmill.operators import metrics as M
from talkmill.operators.extract import non_blank, with_text
from talkmill.sources import admission
from talkmill.sources import tables as S
from talkmill.sources.arrays import json_segments
from talkmill.sources.exports import read_exports, split_segments

Profiles = dict[str, list[str]]


@dataclass
class Ingested:
    """Result of the ingest: clean rows, rejected rows, one summary row."""

    clean: DataFrame
    rejects: DataFrame
    summary: DataFrame


def _language(profiles: Profiles | None) -> Column:
    return identify("text", profiles) if profiles else F.lit(UNKNOWN)


def flatten(conversations: DataFrame, *, variant: str = "cli") -> DataFrame:
    """Every conversation with its text, blank and rejected ones included."""
    return with_text(conversations, variant=variant)


def clean_rows(flattened: DataFrame, profiles: Profiles | None) -> DataFrame:
    """Readable conversations with any text, their language and text hash."""
    return (
        non_blank(flattened.filter(F.col("reject").isNull()))
        .withColumns({"language": _language(profiles), "text_hash": T.text_hash("text")})
        .select(*S.CLEAN_COLUMNS, "pos", "text_hash")
    )


def reject_rows(flattened: DataFrame) -> DataFrame:
    return flattened.filter(F.col("reject").isNotNull()).select(
        "source_file", "pos", F.col("reject").alias("reason")
    )


def ingest(
    spark: SparkSession,
    path: str | list[str],
    *,
    profiles: Profiles | None = None,
    detect: bool = True,
    **source,
) -> Ingested:
    """Exports to clean rows.  Without ``profiles`` the built-in samples tell languages.

    ``source`` goes to ``read_exports``.  Each of the three relations reads the exports anew; ``run_ingest``
    reads them once.
    """
    if detect and profiles is None:
        profiles = sample_model(spark)
    flattened = flatten(read_exports(spark, path, **source))
    language = F.when(
        F.col("reject").isNull() & ~T.is_blank("text"), _language(profiles if detect else None)
    )
    return Ingested(
        clean_rows(flattened, profiles if detect else None),
        reject_rows(flattened),
        M.ingest_summary(flattened.withColumn("language", language)),
    )


def run_ingest(spark: SparkSession, path: str | list[str], output: str, **options) -> Ingested:
    """Ingest and write ``<output>/clean`` (Parquet and CSV), ``rejects`` and ``summary``.

    Every conversation is read and flattened once: the flattened rows are written
    first, and clean rows, rejects and summary are taken from there.
    """
    detect = options.pop("detect", True)
    profiles = options.pop("profiles", None) or (sample_model(spark) if detect else None)
    flattened = flatten(read_exports(spark, path, **options))
    readable = F.col("reject").isNull() & ~T.is_blank("text")
    flattened.withColumn("language", F.when(readable, _language(profiles))).write.parquet(
        f"{output}/flattened"
    )
    flattened = spark.read.parquet(f"{output}/flattened")
    readable = non_blank(flattened.filter(F.col("reject").isNull()))
    result = Ingested(
        readable.withColumn("text_hash", T.text_hash("text")).select(
            *S.CLEAN_COLUMNS, "pos", "text_hash"
        ),
        reject_rows(flattened),
        M.ingest_summary(flattened).withColumn("processing_timestamp", F.current_timestamp()),
    )
    S.write_csv(result.clean.select(*S.CLEAN_COLUMNS), f"{output}/clean_csv")
    S.write_parquet(result.clean, f"{output}/clean")
    S.write_parquet(result.rejects, f"{output}/rejects")
    S.write_json(result.summary, f"{output}/summary")
    return result


def run_embed(
    spark: SparkSession,
    source: str | list[str] | DataFrame,
    store: str,
    output: str,
    encoder: E.Encoder | None = None,
    chunk_size: int = E.CHUNK_SIZE,
) -> DataFrame:
    """Embed the text column of a CSV or of any rows; vectors are keyed, never positional."""
    rows = source if isinstance(source, DataFrame) else S.csv_for_embed(spark, source)
    if "conversation_id" not in rows.columns:
        rows = rows.withColumn("conversation_id", T.text_hash("text"))
    vectors = E.embed(rows, encoder or E.hashing_encoder(), store, chunk_size=chunk_size)
    S.write_parquet(vectors, output)
    return spark.read.parquet(output)


def categorize_rows(df: DataFrame, taxonomy: Taxonomy = DEFAULT, text: str = "text") -> DataFrame:
    """Rows with category, voice flag, confidence, length and complexity."""
    return C.with_length(C.categorize(df, text, taxonomy), text)


#: Rows in a batch of the throughput report.
BATCH_SIZE = 1000


def run_categorize(
    spark: SparkSession,
    source: str | list[str] | DataFrame,
    output: str,
    taxonomy: Taxonomy = DEFAULT,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Categorize a CSV or any rows with a text; writes ``<output>/categorized_csv``, ``metrics`` and ``batches``, returns the metrics.

    The texts are scored once, while the Parquet copy is written; the CSV, the
    metrics and the throughput come from that copy.  A batch is so many rows that a task has scored one
    after the other; each row is written with its batch and the time.
    """
    start = time.monotonic()
    given = source if isinstance(source, DataFrame) else S.csv_for_categorize(spark, source)
    rows = categorize_rows(given, taxonomy)
    S.write_parquet(_timed(rows, batch_size), f"{output}/categorized")

    scored = spark.read.parquet(f"{output}/categorized")
    S.write_parquet(batch_report(scored), f"{output}/batches")
    kept = spark.read.schema(rows.schema).parquet(f"{output}/categorized")
    S.write_csv(kept, f"{output}/categorized_csv")
    elapsed = time.monotonic() - start
    batches = spark.read.parquet(f"{output}/batches").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("batches"), F.min("rows_per_second").alias("slowest_batch")
    )
    figures = batches.first()
    n = figures["rows"]
    performance = F.struct(
        F.lit(round(elapsed, 2)).alias("processing_time_seconds"),
        F.lit(round(n / elapsed, 1) if elapsed > 0 else 0.0).alias("conversations_per_second"),
        F.lit(n).alias("rows"),
        F.lit(batch_size).alias("batch_size_used"),
        F.lit(figures["batches"]).alias("batches"),
        F.lit(figures["slowest_batch"]).cast("double").alias("slowest_batch_per_second"),
    )
    metrics = M.metrics_cli(kept).withColumn("performance", performance)
    S.write_json(metrics, f"{output}/metrics")
    return spark.read.json(f"{output}/metrics")


def _timed(rows: DataFrame, batch_size: int) -> DataFrame:
    """Rows with their task, their batch in it, and the time at which they were scored."""
    number = F.monotonically_increasing_id()
    return rows.withColumns(
        {
            "__task": F.shiftright(number, 33),
            "__batch": F.expr(f"(monotonically_increasing_id() & {(1 << 33) - 1}) div {batch_size}"),
            "__at": F.expr("reflect('java.lang.System', 'nanoTime')").cast("long"),
        }
    )


def batch_report(scored: DataFrame) -> DataFrame:
    """``task, batch, rows, seconds, rows_per_second``; a batch lasts until the next one's first row, the last to its last row."""
    batches = scored.groupBy(F.col("__task").alias("task"), F.col("__batch").alias("batch")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("__at").alias("begin"), F.max("__at").alias("end")
    )
    following = F.lead("begin").over(Window.partitionBy("task").orderBy("batch"))
    seconds = (F.coalesce(following, "end") - F.col("begin")) / 1e9
    return batches.withColumn("seconds", seconds).select(
        "task", "batch", "rows", "seconds", (F.col("rows") / F.greatest("seconds", F.lit(1e-9))).alias("rows_per_second")
    )


def upload_rows(
    clean: DataFrame, taxonomy: Taxonomy = DEFAULT
) -> DataFrame:
    """Result rows of the upload analysis from clean rows."""
    return C.upload_rows(C.categorize(clean, "text", taxonomy))


def _upload_json(spark: SparkSession, paths: list[str], profiles: Profiles | None) -> DataFrame:
    flattened = flatten(split_segments(json_segments(spark, paths, None)), variant="upload")
    return clean_rows(flattened, profiles).select(*S.CLEAN_COLUMNS)


def analyze(
    spark: SparkSession,
    paths: list[str],
    *,
    profiles: Profiles | None = None,
    limits: bool = True,
    taxonomy: Taxonomy = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """Result rows and metrics of uploaded files; JSON and CSV may be mixed.

    All JSON files are one scan, and so are all CSV files, so the plan does not grow with the number of files.

    Files are admitted as a whole or not at all; ``limits=False`` lifts that.
    """
    if limits:
        admission.check(admission.list_files(spark, paths))
    profiles = profiles or sample_model(spark)
    tables = [p for p in paths if p.lower().endswith(".csv")]
    exports = [p for p in paths if p not in tables]
    parts = [_upload_json(spark, exports, profiles)] if exports else []
    if tables:
        parts.append(S.upload_csv_rows(spark, tables))
    clean = parts[0] if parts else spark.createDataFrame([], ", ".join(f"{c} string" for c in S.CLEAN_COLUMNS))
    for p in parts[1:]:
        clean = clean.unionByName(p)
    rows = upload_rows(clean, taxonomy)
    return rows, M.metrics_upload(rows)
