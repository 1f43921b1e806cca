"""Distributions and metric reports.

Every report reads its rows once.  They are first counted per combination of
labels, a small relation after the partial aggregation in each task, and all
distributions and totals are rolled up from that relation by grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.functions.text import COMPLEXITIES

# Fixed value: more hits than this is high confidence.
HIGH_CONFIDENCE = 5
TOP_CATEGORIES = 10

TOTAL = "total"


def round_1(x: Column) -> Column:
    """Round a non-negative double to one decimal, ties of the binary value to even.

    ``round`` and ``bround`` work on the shortest decimal form instead and so give
    0.4 for 0.35, which lies below the tie.  With ``m = 2k + 1`` the sign of
    ``20x - m`` tells the side of the tie; both differences below are exact near it.
    """
    k = F.floor(x * 10)
    m = (2 * k + 1).cast("double")
    side = (x * 16 - m) + x * 4
    up = (side > 0) | ((side == 0) & (k % 2 == 1))
    return F.when(up, k + 1).otherwise(k) / F.lit(10.0)


def _count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _roll_up(facts: DataFrame, dims: list[str], sums: list[str]) -> DataFrame:
    """``kind, key`` and the sums, per label of every dimension and in total."""
    full = (1 << len(dims)) - 1
    sets = [[F.col(d)] for d in dims] + [[]]
    rolled = facts.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("gid"), *[F.sum(s).alias(s) for s in sums]
    )
    kind = F.when(F.col("gid") == full, TOTAL)
    key = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        here = F.col("gid") == full - (1 << (len(dims) - 1 - i))
        kind = kind.when(here, d)
        key = F.when(here, F.col(d).cast("string")).otherwise(key)
    return rolled.select(kind.alias("kind"), key.alias("key"), *sums)


def _total(column: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("kind") == TOTAL, F.col(column))), F.lit(0))


def _counts_map(kind: str, value: str = "n") -> Column:
    """Label counts of one dimension as a map, most common first."""
    here = (F.col("kind") == kind) & F.col("key").isNotNull() & (F.col(value) > 0)
    entry = F.struct(
        (-F.col(value)).alias("rank"), F.col("key").alias("key"), F.col(value).alias("value")
    )
    entries = F.array_sort(F.collect_list(F.when(here, entry)))
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["value"])))


def _label_count(kind: str, key: str) -> Column:
    here = (F.col("kind") == kind) & (F.col("key") == key)
    return F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def distribution(df: DataFrame, column: str, count: str = "conversations") -> DataFrame:
    """Count per label, most common first; a null label is not counted."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias(count))
        .orderBy(F.desc(count), column)
    )


def complexity_distribution(df: DataFrame, count: str = "conversations") -> DataFrame:
    """Count per complexity label, labels without rows included."""
    spark = df.sparkSession
    labels = spark.createDataFrame([(c,) for c in COMPLEXITIES], "complexity string")
    counts = df.groupBy("complexity").agg(F.count(F.lit(1)).alias(count))
    return labels.join(counts, "complexity", "left").select(
        "complexity", F.coalesce(count, F.lit(0)).cast("bigint").alias(count)
    )


def category_facts(df: DataFrame, dims: list[str], text: str | None = None) -> DataFrame:
    """Counts and sums per combination of labels, the base of both reports."""
    zero = F.lit(0).cast("bigint")
    has = set(df.columns)
    length = T.char_length(text) if "char_length" not in has else F.col("char_length")
    confidence = F.col("confidence_score") if "confidence_score" in has else F.lit(None)
    return df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(length).alias("with_length"),
        F.coalesce(F.sum(length), zero).alias("chars"),
        (_count_if(F.col("is_voice")) if "is_voice" in has else F.max(zero)).alias("voice"),
        F.count(confidence).alias("with_confidence"),
        F.coalesce(F.sum(confidence.cast("bigint")), zero).alias("confidence"),
        _count_if(confidence.cast("bigint") > HIGH_CONFIDENCE).alias("high"),
        (F.coalesce(F.sum(T.question_marks(text)), zero) if text else F.max(zero)).alias(
            "questions"
        ),
        (F.coalesce(F.sum(T.follow_ups(text)), zero) if text else F.max(zero)).alias(
            "follow_ups"
        ),
    )


SUMS = [
    "n",
    "with_length",
    "chars",
    "voice",
    "with_confidence",
    "confidence",
    "high",
    "questions",
    "follow_ups",
]


def label_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """All label counts in long form ``metric, key, value``, in one pass over the rows."""
    facts = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    return (
        _roll_up(facts, dims, ["n"])
        .filter((F.col("kind") == TOTAL) | F.col("key").isNotNull())
        .select(F.col("kind").alias("metric"), "key", F.col("n").alias("value"))
    )


def keep_facts(facts: DataFrame, path: str, part: str) -> None:
    """Keep the facts of one part of the rows, a day for instance; kept again, they replace what it had."""
    facts.write.mode("overwrite").parquet(f"{path}/part={part}")


def merged_facts(spark: SparkSession, path: str) -> DataFrame:
    """The facts of all parts kept, as if they came from all their rows at once; no row is read again."""
    kept = spark.read.parquet(path).drop("part")
    sums = [c for c in kept.columns if c in (*SUMS, "valid", "rejected")]
    merge = {"shortest": F.min, "longest": F.max}
    dims = [c for c in kept.columns if c not in sums and c not in merge]
    return kept.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in sums], *[f(c).alias(c) for c, f in merge.items() if c in kept.columns])


CLI_DIMS = ["main_category", "subcategory", "complexity"]
UPLOAD_DIMS = ["main_category", "subcategory", "language", "complexity", "source_file"]


def cli_facts(df: DataFrame, text: str = "text") -> DataFrame:
    """The base of ``metrics_cli``, to be kept and merged."""
    if "complexity" not in df.columns:
        df = df.withColumn("complexity", T.complexity_cli(T.char_length(text)))
    return category_facts(df, CLI_DIMS, text)


def upload_facts(df: DataFrame) -> DataFrame:
    """The base of ``metrics_upload``, to be kept and merged."""
    return category_facts(df, UPLOAD_DIMS)


def metrics_cli(df: DataFrame, text: str = "text") -> DataFrame:
    """The batch job's metrics as one row; zeros for an empty input."""
    return cli_report(cli_facts(df, text))


def cli_report(facts: DataFrame) -> DataFrame:
    rolled = _roll_up(facts, CLI_DIMS, SUMS)
    labels = F.array(*[F.lit(c) for c in COMPLEXITIES])
    counts = F.array(*[_label_count("complexity", c) for c in COMPLEXITIES])
    return rolled.agg(
        _total("n").alias("total_conversations"),
        _ratio(_total("chars"), _total("with_length")).alias("avg_length"),
        _counts_map("main_category").alias("category_distribution"),
        _counts_map("subcategory").alias("subcategory_distribution"),
        _total("voice").alias("voice_conversations"),
        F.map_from_arrays(labels, counts).alias("complexity_scores"),
        F.struct(
            _total("questions").alias("questions"), _total("follow_ups").alias("follow_ups")
        ).alias("interaction_patterns"),
        F.struct(
            _ratio(_total("confidence"), _total("with_confidence")).alias("avg_confidence"),
            _total("high").alias("high_confidence"),
        ).alias("confidence_metrics"),
    )


def metrics_upload(df: DataFrame) -> DataFrame:
    """The upload analysis' metrics as one row; no row for an empty input."""
    return upload_report(upload_facts(df))


def upload_report(facts: DataFrame) -> DataFrame:
    rolled = _roll_up(facts, UPLOAD_DIMS, SUMS)
    n = _total("n")
    is_file = (F.col("kind") == "source_file") & F.col("key").isNotNull()
    return rolled.agg(
        n.alias("total_conversations"),
        round_1(_ratio(_total("chars"), n)).alias("avg_length"),
        _counts_map("main_category").alias("category_distribution"),
        _counts_map("subcategory").alias("subcategory_distribution"),
        _counts_map("language").alias("language_distribution"),
        _counts_map("complexity").alias("complexity_distribution"),
        _total("voice").alias("voice_conversations"),
        round_1(_ratio(_total("confidence"), n)).alias("confidence_avg"),
        round_1(_ratio(_total("high"), n) * 100).alias("confidence_high_pct"),
        F.count_if(is_file).alias("files_processed"),
    ).filter("total_conversations > 0")


def ingest_summary(extracted: DataFrame) -> DataFrame:
    """Counts of the ingest as one row.

    ``extracted`` holds every conversation, blank ones too, with ``source_file,
    text, language`` and ``reject`` (null unless it could not be read).
    """
    return summary_report(summary_facts(extracted))


def summary_facts(extracted: DataFrame) -> DataFrame:
    """The base of ``ingest_summary``, to be kept and merged."""
    accepted = F.col("reject").isNull() if "reject" in extracted.columns else F.lit(True)
    valid = accepted & ~T.is_blank(F.coalesce("text", F.lit("")))
    rows = extracted.withColumns(
        {"valid": valid, "length": F.when(valid, T.char_length("text"))}
    )
    return rows.groupBy("language", "source_file").agg(
        F.count_if(accepted).alias("n"),
        F.count_if("valid").alias("valid"),
        F.count_if(~accepted).alias("rejected"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("chars"),
        F.min("length").alias("shortest"),
        F.max("length").alias("longest"),
    )


def summary_report(facts: DataFrame) -> DataFrame:
    rolled = facts.groupingSets(
        [[F.col("language")], [F.col("source_file")], []], F.col("language"), F.col("source_file")
    ).agg(
        F.grouping_id().alias("gid"),
        F.sum("n").alias("n"),
        F.sum("valid").alias("valid"),
        F.sum("rejected").alias("rejected"),
        F.sum("chars").alias("chars"),
        F.min("shortest").alias("shortest"),
        F.max("longest").alias("longest"),
    )
    rolled = rolled.select(
        F.when(F.col("gid") == 3, TOTAL)
        .when(F.col("gid") == 1, "language")
        .otherwise("source_file")
        .alias("kind"),
        F.col("language").alias("key"),
        "n",
        "valid",
        "rejected",
        "chars",
        "shortest",
        "longest",
    )
    total, good = _total("n"), _total("valid")
    return rolled.agg(
        F.count_if((F.col("kind") == "source_file") & (F.col("valid") > 0)).alias(
            "total_files_processed"
        ),
        total.alias("total_conversations"),
        (total - good).alias("empty_conversations"),
        good.alias("valid_conversations"),
        _total("rejected").alias("rejected_conversations"),
        (_ratio(good, total) * 100).alias("success_rate"),
        _counts_map("language", "valid").alias("language_distribution"),
        F.struct(
            _total("shortest").alias("min"),
            _total("longest").alias("max"),
            _ratio(_total("chars"), good).alias("avg"),
        ).alias("text_length_stats"),
    )


def top_categories(df: DataFrame, n: int = TOP_CATEGORIES) -> DataFrame:
    """The most common categories with their share of all rows in percent.

    The first ``n`` of the label counts, one row per category, are the report.
    """
    counts = label_counts(df, ["main_category"])
    total = counts.filter(F.col("metric") == TOTAL).select(F.col("value").alias("total"))
    first = (
        counts.filter(F.col("metric") != TOTAL).orderBy(F.desc("value"), "key").limit(n)
    )
    ranked = first.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("value"), "key")).cast("bigint")
    )
    return ranked.join(total).select(
        "rank",
        F.col("key").alias("main_category"),
        F.col("value").alias("conversations"),
        (F.col("value") / F.col("total") * 100).alias("share_pct"),
    )


def voice_split(df: DataFrame) -> DataFrame:
    """Number of voice and of text conversations."""
    return df.groupBy("is_voice").agg(F.count(F.lit(1)).alias("conversations"))
