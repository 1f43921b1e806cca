"""URL filters: rules first, gradient-boosted trees on lexical features for the urls that no rule fits.

Urls that a rule fits are the labelled ones; the trees learn from a sample of them, bounded by about SAMPLE picked by hash.
Features: lengths, depth, digit ratio, character entropy, counts of parameters, labels and marks, the longest run of digits, and for the
host's suffixes of two and three labels and the path's first section how many labelled urls they have and how often these are blocked (smoothed towards the common
share, which an unseen suffix gets). A url that is learned from sees the shares of the other folds, so its own label is never a feature.

All of it is DataFrame and SQL work. A suffix may hold a third of the urls: its count is summed before it is shuffled, and its one
rows are joined back by whichever way the table's measured size allows. Null urls, and urls without ://, have an empty host and path; no rule
fits them. Repeated rows give equal results; only the id and url columns are read. Without labels of both kinds every other url is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkmill.llm.components import written

#: Fixed rules: verdict and host/path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
SAMPLE = 20_000
TREES, DEPTH = 12, 4
BLOCK_FROM = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    rest = F.expr(f"if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    at_host = (F.col("host") == host) | F.col("host").endswith("." + host)
    return at_host & F.col("path").startswith(slash + path)


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds the longest fitting rule and its verdict, or nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    none = F.lit(None).cast("string")
    pick = lambda value: reduce(lambda rest, r: F.when(_fits(r[1]), value(r)).otherwise(rest), reversed(ordered), none)
    return df.withColumns({"rule": pick(lambda r: F.lit(r[1])), "ruled": pick(lambda r: F.lit(r[0]))})


FEATURES = {
    "length": "char_length(url)",
    "host_length": "char_length(host)",
    "path_length": "char_length(path)",
    "depth": "regexp_count(path, '/')",
    "labels": "size(split(host, '[.]'))",
    "digit_ratio": "regexp_count(url, '[0-9]') / greatest(1, char_length(url))",
    "digit_run": "coalesce(array_max(transform(regexp_extract_all(url, '[0-9]+', 0), x -> char_length(x))), 0)",
    "parameters": "regexp_count(url, '[?&][^=&#]+=')",
    "hyphens": "regexp_count(host, '-')",
    "fragment": "cast(instr(url, '#') > 0 as int)",
    "secure": "cast(startswith(url, 'https:') as int)",
    "slash_end": "cast(endswith(path, '/') as int)",
    "entropy": """coalesce(aggregate(
        transform(array_distinct(split(url, '')), c -> (char_length(url) - char_length(replace(url, c, ''))) / greatest(1, char_length(url))),
        0D, (a, p) -> if(p > 0, a - p * log2(p), a)), 0D)""",
    "host_entropy": """coalesce(aggregate(
        transform(array_distinct(split(host, '')), c -> (char_length(host) - char_length(replace(host, c, ''))) / greatest(1, char_length(host))),
        0D, (a, p) -> if(p > 0, a - p * log2(p), a)), 0D)""",
}
#: Suffixes of so many labels have statistics of their own.
SUFFIXES = (2, 3)
FOLDS = 5
#: Labelled urls of no known kind that a suffix's share is drawn towards the common one with.
PRIOR = 5


def _suffix(labels: int) -> str:
    return f"array_join(slice(split(host, '[.]'), -least({labels}, size(split(host, '[.]'))), {labels}), '.')"


def with_features(df: DataFrame) -> DataFrame:
    given = df.withColumn("url", F.coalesce("url", F.lit("")))
    return given.withColumns({name: F.expr(f"cast({text} as double)") for name, text in FEATURES.items()}).withColumns(
        {f"suffix{n}": F.expr(_suffix(n)) for n in SUFFIXES}
        | {"section": F.expr("coalesce(get(split(path, '/'), 1), '')"), "fold": F.pmod(F.xxhash64("url", F.lit(9)), F.lit(FOLDS))}
    )


def _shares(labelled: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, bad, all) of labelled urls, by key and by key and fold: how many there are and how many of them are blocked."""
    by_fold = written(labelled.groupBy(key, "fold").agg(F.sum("blocked").alias("bad"), F.count("*").alias("all")), f"{key}-folds")
    return by_fold.groupBy(key).agg(F.sum("bad").alias("bad"), F.sum("all").alias("all")), by_fold


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row of df; score is null where a rule fits."""
    scored = score_urls(df, id_col, url_col, rules, sample)
    # Without labels of both kinds every other url is allowed.
    guess = F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")
    score = F.when(F.col("ruled").isNull(), F.col("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", guess).alias("verdict"), score.alias("score"))


def score_urls(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE, learn: str = "true"
) -> DataFrame:
    """(page_id, url, host, path, rule, ruled, score): what the trees make of every url, ruled or not; null without labels of both kinds.

    learn, an expression over host and path, can keep ruled urls out of all that is learned, to be judged as strange ones.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    ruled = with_rule(with_parts(pages), rules).withColumn("blocked", (F.col("ruled") == "block").cast("double"))
    labelled = ruled.filter("ruled is not null").filter(learn)
    counts = labelled.agg(F.count("*").alias("all"), F.coalesce(F.sum("blocked"), F.lit(0.0)).alias("bad")).first()
    out = ["page_id", "url", "host", "path", "rule", "ruled"]
    unscored = ruled.select(*out, F.lit(None).cast("double").alias("score"))
    if not 0 < counts["bad"] < counts["all"]:
        return unscored
    common = counts["bad"] / counts["all"]
    shares = {key: _shares(with_features(labelled), key) for key in (*(f"suffix{n}" for n in SUFFIXES), "section")}
    names = [*FEATURES, *(f"{key}_share" for key in shares), *(f"{key}_seen" for key in shares)]

    def complete(rows: DataFrame, learning: bool) -> DataFrame:
        """Adds the share of blocked urls and the number of labelled ones for each suffix; a url to learn from sees other folds alone."""
        for key, (whole, by_fold) in shares.items():
            rows = rows.join(whole, key, "left").fillna(0, ["bad", "all"])
            if learning:
                own = by_fold.withColumnsRenamed({"bad": "own_bad", "all": "own_all"})
                rows = rows.join(own, [key, "fold"], "left").fillna(0, ["own_bad", "own_all"])
                rows = rows.withColumns({"bad": F.col("bad") - F.col("own_bad"), "all": F.col("all") - F.col("own_all")}).drop("own_bad", "own_all")
            share = (F.col("bad") + PRIOR * common) / (F.col("all") + PRIOR)
            rows = rows.withColumns({f"{key}_share": share, f"{key}_seen": F.log1p("all")}).drop("bad", "all")
        return rows

    assembler = VectorAssembler(inputCols=names, outputCol="features")
    # Copies of a url are one, so a hot one cannot fill the sample.
    distinct = labelled.select("url", "host", "path", "blocked").distinct()
    taken = distinct.filter(F.pmod(F.xxhash64("url", F.lit(5)), F.lit(1_000_000)) < max(1, int(1e6 * min(1, sample / counts["all"]))))
    training = written(complete(with_features(taken), True).select(*names, "blocked").repartition(4), "url-sample")
    if training.select("blocked").distinct().count() < 2:
        return unscored
    model = GBTClassifier(labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(assembler.transform(training))
    scored = model.transform(assembler.transform(complete(with_features(ruled), False)))
    return scored.select(*out, vector_to_array("probability")[1].alias("score"))


def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
