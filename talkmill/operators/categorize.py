"""Topic scores and labels from the keyword taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.functions.keywords import (
    count_keywords,
    group_counts,
    group_pattern,
    has_keyword,
    reduce_text,
)
from talkmill.functions.once import let, sql_list, sql_text, with_once
from talkmill.functions.taxonomy import (
    DANISH_MARKERS,
    DEFAULT,
    NO_CATEGORY,
    NO_SUBCATEGORY,
    VOICE_KEYWORDS,
    Taxonomy,
)

REDUCED, HITS, VOICE = "__reduced", "__hits", "__voice"


def is_voice(text: Column | str) -> Column:
    """True where a text names voice, audio or the like."""
    return has_keyword(text, VOICE_KEYWORDS)


def is_danish(text: Column | str) -> Column:
    """True where a text has at least two Danish marker words."""
    return count_keywords(text, DANISH_MARKERS) >= 2


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def _layout(taxonomy: Taxonomy) -> Column:
    """Per category: name, place and number of its groups, names of its subcategories.

    A literal array that lambdas run over keeps the generated code small.
    """
    rows = []
    for c in taxonomy.categories:
        subs = [taxonomy.groups[i].subcategory for i in taxonomy.sub_indexes(c)]
        rows.append(
            f"named_struct('category', {sql_text(c)}, 'first', {taxonomy.main_index(c) + 1}, "
            f"'groups', {1 + len(subs)}, 'subcategories', {sql_list(subs)})"
        )
    return F.expr(f"array({', '.join(rows)})")


def with_hits(df: DataFrame, text: str = "text", taxonomy: Taxonomy = DEFAULT) -> DataFrame:
    """Add the hit count of every keyword group, in one scan of each text.

    Voice words ride along in the same scan.  Only the rare dotted capital I
    tells the text from its lower-cased form there, so that case looks again.
    """
    words = [*taxonomy.keywords, *VOICE_KEYWORDS]
    folded = T.fold(F.coalesce(F.col(text), F.lit("")))
    reduced = df.withColumn(REDUCED, reduce_text(folded, words))
    voice = F.when(F.contains(F.col(text), F.lit("İ")), is_voice(text)).otherwise(
        F.rlike(F.col(REDUCED), F.lit(group_pattern(VOICE_KEYWORDS)))
    )
    hits = group_counts(REDUCED, [g.keywords for g in taxonomy.groups])
    return reduced.withColumns({HITS: hits, VOICE: voice}).drop(REDUCED)


def labels(taxonomy: Taxonomy = DEFAULT) -> Column:
    """``main_category, subcategory, confidence_score`` from the group hits.

    ``array_position`` finds the first of equal values, which is the tie rule.
    """
    layout = _layout(taxonomy)
    totals = F.transform(layout, lambda g: _sum(F.slice(F.col(HITS), g["first"], g["groups"])))

    def of_totals(totals: Column) -> Column:
        best = F.array_max(totals)
        winner = F.element_at(layout, F.array_position(totals, best).cast("int"))
        return F.struct(best.alias("best"), winner.alias("winner"))

    def of_winner(found: Column) -> Column:
        winner = found["winner"]
        counts = F.slice(F.col(HITS), winner["first"] + 1, winner["groups"] - 1)
        sub = let(
            counts,
            lambda n: F.get(
                winner["subcategories"], (F.array_position(n, F.array_max(n)) - 1).cast("int")
            ),
        )
        no_hit = found["best"] == 0
        return F.struct(
            F.when(no_hit, NO_CATEGORY).otherwise(winner["category"]).alias("main_category"),
            F.when(no_hit, NO_SUBCATEGORY)
            .otherwise(F.coalesce(sub, F.lit(NO_SUBCATEGORY)))
            .alias("subcategory"),
            found["best"].alias("confidence_score"),
        )

    return let(let(totals, of_totals), of_winner)


def score_tree(taxonomy: Taxonomy = DEFAULT) -> Column:
    """All scores as a map from category to its main, sub and total scores."""

    def tree(g: Column) -> Column:
        counts = F.transform(
            F.slice(F.col(HITS), g["first"], g["groups"]), lambda n: n.cast("bigint")
        )
        subs = F.map_from_arrays(g["subcategories"], F.slice(counts, F.lit(2), g["groups"] - 1))
        return F.struct(
            g["category"],
            F.struct(
                F.get(counts, F.lit(0)).alias("main_score"),
                subs.alias("sub_scores"),
                _sum(counts).alias("total_score"),
            ),
        )

    return F.map_from_entries(F.transform(_layout(taxonomy), tree))


def categorize(
    df: DataFrame,
    text: str = "text",
    taxonomy: Taxonomy = DEFAULT,
    *,
    all_scores: bool = False,
) -> DataFrame:
    """Add ``main_category, subcategory, is_voice, confidence_score`` to every row.

    Row-local: one scan of the text, no shuffle.  A null text scores nothing.
    """
    columns = [F.col(c) for c in df.columns]
    computed = {
        "__labels": labels(taxonomy),
        "is_voice": F.coalesce(F.col(VOICE), F.lit(False)),
    }
    if all_scores:
        computed["all_scores"] = score_tree(taxonomy)
    rows = with_once(with_hits(df, text, taxonomy), computed)
    return rows.select(
        *columns,
        "__labels.main_category",
        "__labels.subcategory",
        "is_voice",
        "__labels.confidence_score",
        *(["all_scores"] if all_scores else []),
    )


def category_scores(
    df: DataFrame, keys: list[str], text: str = "text", taxonomy: Taxonomy = DEFAULT
) -> DataFrame:
    """Scores in long form: ``keys, category, subcategory, hits`` (null subcategory = main)."""
    names = F.expr(
        "array("
        + ", ".join(
            f"named_struct('category', {sql_text(g.category)}, 'subcategory', "
            f"{'cast(null as string)' if g.subcategory is None else sql_text(g.subcategory)})"
            for g in taxonomy.groups
        )
        + ")"
    )
    scored = with_hits(df.select(*keys, text), text, taxonomy).select(
        *keys, F.explode(F.arrays_zip(names.alias("g"), F.col(HITS).alias("h"))).alias("e")
    )
    return scored.select(
        *keys,
        F.col("e.g.category").alias("category"),
        F.col("e.g.subcategory").alias("subcategory"),
        F.coalesce(F.col("e.h").cast("bigint"), F.lit(0)).alias("hits"),
    )


def with_length(df: DataFrame, text: str = "text", *, variant: str = "cli") -> DataFrame:
    """Add ``char_length`` and ``complexity``."""
    bucket = T.complexity_cli if variant == "cli" else T.complexity_upload
    return df.withColumn("char_length", T.char_length(text)).withColumn(
        "complexity", bucket("char_length")
    )


def upload_rows(categorized: DataFrame, text: str = "text") -> DataFrame:
    """The result rows of the upload analysis: a preview in place of the text."""
    rows = with_length(categorized, text, variant="upload")
    return rows.select(
        "conversation_id",
        T.preview(text).alias("text_preview"),
        "language",
        "source_file",
        "main_category",
        "subcategory",
        "is_voice",
        "confidence_score",
        "char_length",
        "complexity",
    )
