"""Conversations kept as one row per turn.

A conversation may be very long, up to a large part of all rows, so its turns
never meet in one group unreduced: turns are first brought together in chunks
of ``CHUNK_TURNS`` consecutive turn numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.functions.keywords import group_counts, joinable, reduce_text, turn_runs
from talkmill.functions.once import with_once
from talkmill.functions.taxonomy import DEFAULT, VOICE_KEYWORDS, Taxonomy
from talkmill.operators.categorize import HITS, is_voice, labels

CHUNK_TURNS = 4096


def _in_order(order: str, value: str) -> Column:
    """Values of a group joined by a blank in turn order, turns without a number last.

    Null values are left out; equal turn numbers are ordered by value.
    """
    place = F.struct(F.col(order).isNull().alias("unplaced"), order, value)
    present = F.when(F.col(value).isNotNull(), place)
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(present)), lambda x: x[value]), " "
    )


def _chunk(order: str, size: int) -> Column:
    """First turn number of the chunk a turn belongs to; null for turns without a number."""
    return (F.col(order) - F.pmod(F.col(order), F.lit(size))).alias("chunk")


def _fragments(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """A turn contributes its stripped text unless it has none at all."""
    fragment = F.when(F.col(text) != "", T.strip(text))
    return turns.select(key, order, fragment.alias("fragment"))


def conversation_text(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text"
) -> DataFrame:
    """One row ``key, text`` per conversation: stripped turns in order, joined by a blank.

    The result holds a conversation in one cell, so its turns meet in one group; ``categorize_conversations``
    does without that.
    """
    fragments = _fragments(turns, key, order, text)
    joined = F.when(F.count("fragment") > 0, _in_order(order, "fragment"))
    return fragments.groupBy(key).agg(F.coalesce(joined, F.lit("")).alias("text"))


def categorize_conversations(
    turns: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    text: str = "text",
    taxonomy: Taxonomy = DEFAULT,
    chunk_turns: int = CHUNK_TURNS,
) -> DataFrame:
    """Categorize conversations without ever putting their texts together.

    Gives what ``categorize`` gives on ``conversation_text``: ``key, char_length,
    main_category, subcategory, is_voice, confidence_score`` of every conversation
    that is not blank.  Each turn is reduced to its keyword runs before the first
    shuffle.  Hits inside a chunk are counted there and summed up; only the runs
    at a chunk's two ends go on, because a keyword may reach into the next chunk.
    """
    words = [*taxonomy.keywords, *VOICE_KEYWORDS]
    groups = [*[g.keywords for g in taxonomy.groups], VOICE_KEYWORDS]
    n = len(groups)

    reduced = _fragments(turns, key, order, text).select(
        key,
        order,
        turn_runs(T.fold("fragment"), words).alias("runs"),
        T.char_length("fragment").alias("chars"),
        (F.col("fragment") != "").alias("said"),
        F.when(F.contains("fragment", F.lit("İ")), is_voice("fragment")).alias("dotted_voice"),
    )
    pieces = (
        reduced.withColumn("runs", F.when(F.col("runs").isNotNull(), joinable(F.col("runs"))))
        .groupBy(key, _chunk(order, chunk_turns))
        .agg(
            F.when(F.count("runs") > 0, _in_order(order, "runs")).alias("piece"),
            F.sum("chars").alias("chars"),
            F.count("chars").alias("fragments"),
            F.bool_or("said").alias("said"),
            F.bool_or("dotted_voice").alias("dotted_voice"),
        )
    )
    piece, left, right = F.col("piece"), F.col("left"), F.col("right")
    split = pieces.withColumns(
        {
            "left": F.substring_index(piece, "\n", 1),
            "right": F.substring_index(piece, "\n", -1),
        }
    )
    broken = F.contains(piece, F.lit("\n"))
    inside = F.substring(
        piece,
        F.length(left) + 1,
        F.length(piece) - F.length(left) - F.length(right),
    )
    counted = split.select(
        key,
        "chunk",
        "chars",
        "fragments",
        "said",
        "dotted_voice",
        F.when(broken, F.concat(left, F.lit("\n"), right)).otherwise(piece).alias("ends"),
        reduce_text(F.when(broken, inside).otherwise(""), words).alias("inside"),
    ).withColumn("counts", group_counts("inside", groups))
    summed = ", ".join(f"sum(counts[{i}])" for i in range(n))
    whole = (
        counted.groupBy(key)
        .agg(
            F.expr(f"array({summed})").alias("counts"),
            _in_order("chunk", "ends").alias("ends"),
            (F.sum("chars") + F.sum("fragments") - 1).alias("char_length"),
            F.bool_or("said").alias("said"),
            F.bool_or("dotted_voice").alias("dotted_voice"),
        )
        .filter("said")
        .withColumn("ends", reduce_text(F.col("ends"), words))
        .withColumn("end_counts", group_counts("ends", groups))
    )
    hits = whole.select(
        key,
        "char_length",
        "dotted_voice",
        F.zip_with("counts", "end_counts", lambda a, b: a + b).alias(HITS),
    )
    voice = (F.get(F.col(HITS), F.lit(n - 1)) > 0) | F.coalesce("dotted_voice", F.lit(False))
    rows = with_once(hits, {"__labels": labels(taxonomy), "is_voice": voice})
    return rows.select(
        key,
        "char_length",
        "__labels.main_category",
        "__labels.subcategory",
        "is_voice",
        "__labels.confidence_score",
    )
