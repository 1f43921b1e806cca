"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions import language as L
from talkmill.functions import text as T
from talkmill.functions.once import with_once
from talkmill.operators import categorize as C
from talkmill.operators import conversations as V
from talkmill.operators import embed as E
from talkmill.operators import explore as X
from talkmill.operators import extract as J
from talkmill.operators import language_cache as LC
from talkmill.operators import metrics as M
from talkmill.plans import benchmark, jobs
from talkmill.sources import admission as A
from talkmill.sources import exports as S
from talkmill.sources import tables as CSV
from talkmill.sources.store import shared_folder
from talkmill.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HASH_DIM = 64


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# A session may ask for tables that are one small file to be dealt out to so many tasks.
DEAL = "spark.talkmill.deal"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get(DEAL, None)
    return rows.repartition(int(tasks)) if tasks else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_clean(documents(spark, sf_dir))


def as_clean(docs: DataFrame) -> DataFrame:
    """Documents as clean rows; ``source`` stands for the file."""
    return docs.select(
        F.col("doc_id").cast("string").alias("conversation_id"),
        "text",
        F.col("lang").alias("language"),
        F.col("source").alias("source_file"),
    )


def categorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.categorize_rows(clean(spark, sf_dir))


def uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.upload_rows(clean(spark, sf_dir))


def map_text(c: str | Column) -> Column:
    """A count map as ``label=count;...`` in its own order, to be comparable anywhere."""
    entries = F.map_entries(c)
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))),
        ";",
    )


def vector_text(c: str | Column) -> Column:
    """A vector as whole ten-thousandths."""
    return F.array_join(
        F.transform(c, lambda x: F.round(x * 10000).cast("bigint").cast("string")), ","
    )


# Conversations kept as turns


@query
def conv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.non_blank(V.conversation_text(turns(spark, sf_dir)))


@query
def conv_categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.categorize_conversations(turns(spark, sf_dir))


@query
def conv_category_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.distribution(V.categorize_conversations(turns(spark, sf_dir)), "main_category")


def unplaced_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth turn has lost its number."""
    number = F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, F.col("turn"))
    return turns(spark, sf_dir).withColumn("turn", number)


@query
def conv_text_null_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.non_blank(V.conversation_text(unplaced_turns(spark, sf_dir)))


@query
def conv_categorize_null_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In chunks of two turns, so that most keywords of two words meet a chunk's end."""
    return V.categorize_conversations(unplaced_turns(spark, sf_dir), chunk_turns=2)


# Texts made of the taxonomy's keywords, so that every group and label is met


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose texts hold all keywords of one group, and by id a second group, voice words,
    questions, follow-ups, nothing known, or only blanks."""
    n = F.col("doc_id")
    groups = F.array(*[F.lit(" ".join(g.keywords)) for g in C.DEFAULT.groups])

    def every(k: int, words: str | Column) -> Column:
        return F.when(n % k == 0, words if isinstance(words, Column) else F.lit(words))

    size = len(C.DEFAULT.groups)
    text = F.concat_ws(
        " ",
        F.get(groups, (n % size).cast("int")),
        every(3, F.get(groups, (n * 31 % size).cast("int"))),
        every(7, " ".join(C.VOICE_KEYWORDS)),
        every(5, "why? what?? follow up, additional"),
    )
    only = F.when(n % 13 == 0, F.lit(" \t ")).when(n % 17 == 0, F.lit("qwrt zzz mnop"))
    return documents(spark, sf_dir).withColumn("text", F.coalesce(only, text))


def planted_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_clean(planted(spark, sf_dir))


@query
def planted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.category_scores(planted(spark, sf_dir), ["doc_id"])


@query
def planted_categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.categorize(planted(spark, sf_dir)).select(
        "doc_id", "main_category", "subcategory", "is_voice", "confidence_score"
    )


@query
def planted_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select(
        "doc_id",
        C.is_voice("text").alias("is_voice"),
        T.question_marks("text").alias("questions"),
        T.follow_ups("text").alias("follow_ups"),
    )


@query
def planted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_fields(M.ingest_summary(planted_clean(spark, sf_dir)))


@query
def planted_metrics_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cli_fields(M.metrics_cli(jobs.categorize_rows(planted_clean(spark, sf_dir))))


@query
def planted_metrics_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upload_fields(M.metrics_upload(jobs.upload_rows(planted_clean(spark, sf_dir))))


# Scalar functions


@query
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.text_hash("text").alias("text_hash"))


@query
def hash_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = documents(spark, sf_dir).select(T.text_hash("text").alias("text_hash"))
    return hashed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query
def detection_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.detection_prefix("text").alias("prefix"))


@query
def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", T.strip("text").alias("text"))


@query
def voice_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", C.is_voice("text").alias("is_voice"))


@query
def danish_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id",
        C.count_keywords("text", C.DANISH_MARKERS).alias("markers"),
        C.is_danish("text").alias("is_danish"),
    )


@query
def complexity_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_length(documents(spark, sf_dir)).select("doc_id", "char_length", "complexity")


@query
def complexity_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_length(documents(spark, sf_dir), variant="upload").select(
        "doc_id", "char_length", "complexity"
    )


@query
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.preview("text").alias("text_preview"))


@query
def interaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id",
        T.question_marks("text").alias("questions"),
        T.follow_ups("text").alias("follow_ups"),
    )


@query
def interaction_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).agg(
        F.sum(T.question_marks("text")).alias("questions"),
        F.sum(T.follow_ups("text")).alias("follow_ups"),
    )


@query
def default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uploaded CSV that has neither ids nor languages, in parts by ``doc_id``.

    Ids are positions in the parts laid end to end: a row's position in its own part, and the rows of all parts before it.
    """
    folder = shared_folder(spark, "bare")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    CSV.write_csv(rows.select("text"), folder)
    # one small row for each part comes to the driver; parts are named in the order of their ranges
    sizes = CSV.read_csv(spark, folder).groupBy("__file").count().orderBy("__file").collect()
    before = np.cumsum([0, *[r["count"] for r in sizes]]).tolist()
    parts = spark.createDataFrame(
        [(r["__file"], n) for r, n in zip(sizes, before, strict=False)], "source_file string, before long"
    )
    own = F.substring_index("conversation_id", "_", -1).cast("long")
    return CSV.upload_csv_rows(spark, folder).join(parts, "source_file").select(
        F.concat(F.lit("row_"), (own + F.col("before")).cast("string")).alias("conversation_id"), "text", "language"
    )


# Scores and labels


@query
def taxonomy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each keyword of the taxonomy table occurs in the documents."""
    hits = C.category_scores(documents(spark, sf_dir), ["doc_id"])
    per_group = hits.groupBy("category", "subcategory").agg(F.sum("hits").alias("hits"))
    groups = C.DEFAULT.table(spark).groupBy("cat_ord", "category", "sub_ord", "subcategory")
    sizes = groups.agg(F.count(F.lit(1)).alias("keywords"))
    same = (per_group["category"] == sizes["category"]) & per_group["subcategory"].eqNullSafe(
        sizes["subcategory"]
    )
    return sizes.join(per_group, same).select(
        "cat_ord", "sub_ord", sizes["category"], "keywords", "hits"
    )


@query
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.category_scores(documents(spark, sf_dir), ["doc_id"])


@query
def score_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.categorize(documents(spark, sf_dir), all_scores=True)
    return rows.select("doc_id", F.explode("all_scores").alias("category", "scores")).select(
        "doc_id",
        "category",
        F.col("scores.main_score").alias("main_score"),
        map_text(F.col("scores.sub_scores")).alias("sub_scores"),
        F.col("scores.total_score").alias("total_score"),
    )


@query
def categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.categorize(documents(spark, sf_dir)).select(
        "doc_id", "main_category", "subcategory", "is_voice", "confidence_score"
    )


@query
def categorize_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch entry on another table with a text column."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return C.categorize(items).drop("text")


@query
def categorized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorized(spark, sf_dir).drop("text")


@query
def upload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploaded(spark, sf_dir)


# Aggregations


@query
def language_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.distribution(clean(spark, sf_dir), "language")


@query
def category_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.distribution(categorized(spark, sf_dir), "main_category")


@query
def subcategory_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.distribution(categorized(spark, sf_dir), "subcategory")


@query
def complexity_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.complexity_distribution(C.with_length(clean(spark, sf_dir)))


@query
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = ["main_category", "subcategory", "language", "complexity", "source_file"]
    return M.label_counts(categorized(spark, sf_dir), dims)


@query
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_fields(M.ingest_summary(clean(spark, sf_dir)))


def summary_fields(s: DataFrame) -> DataFrame:
    return s.select(
        "total_files_processed",
        "total_conversations",
        "empty_conversations",
        "valid_conversations",
        "rejected_conversations",
        "success_rate",
        map_text("language_distribution").alias("language_distribution"),
        F.col("text_length_stats.min").cast("bigint").alias("length_min"),
        F.col("text_length_stats.max").cast("bigint").alias("length_max"),
        F.col("text_length_stats.avg").alias("length_avg"),
    )


@query
def metrics_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cli_fields(M.metrics_cli(categorized(spark, sf_dir)))


def cli_fields(m: DataFrame) -> DataFrame:
    return m.select(
        "total_conversations",
        "avg_length",
        map_text("category_distribution").alias("category_distribution"),
        map_text("subcategory_distribution").alias("subcategory_distribution"),
        "voice_conversations",
        map_text("complexity_scores").alias("complexity_scores"),
        F.col("interaction_patterns.questions").alias("questions"),
        F.col("interaction_patterns.follow_ups").alias("follow_ups"),
        F.col("confidence_metrics.avg_confidence").alias("avg_confidence"),
        F.col("confidence_metrics.high_confidence").alias("high_confidence"),
    )


@query
def metrics_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upload_fields(M.metrics_upload(uploaded(spark, sf_dir)))


def upload_fields(m: DataFrame) -> DataFrame:
    return m.select(
        "total_conversations",
        "avg_length",
        map_text("category_distribution").alias("category_distribution"),
        map_text("subcategory_distribution").alias("subcategory_distribution"),
        map_text("language_distribution").alias("language_distribution"),
        map_text("complexity_distribution").alias("complexity_distribution"),
        "voice_conversations",
        "confidence_avg",
        "confidence_high_pct",
        "files_processed",
    )


@query
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_categories(categorized(spark, sf_dir))


# Exploration


@query
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.search(uploaded(spark, sf_dir), "The")


@query
def filter_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.filter_category(uploaded(spark, sf_dir), "Technical Support")


@query
def category_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.category_options(uploaded(spark, sf_dir))


@query
def filter_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.filter_complexity(uploaded(spark, sf_dir), "medium")


@query
def sort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sort_rows(uploaded(spark, sf_dir), "char_length", descending=True)


@query
def sort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.page(uploaded(spark, sf_dir), "confidence_score", number=1, descending=True)


@query
def page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.page_after(uploaded(spark, sf_dir), "char_length", 400, "50")


@query
def voice_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.voice_split(uploaded(spark, sf_dir))


@query
def confidence_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.confidence_histogram(uploaded(spark, sf_dir))


# Language


def training(docs: DataFrame) -> DataFrame:
    """The labelled rows that profiles are trained on; the other fifth tells how good they are."""
    return docs.filter("doc_id % 5 <> 0")


@query
def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.profile(documents(spark, sf_dir))


@query
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = L.model(L.profile(training(docs)))
    return docs.select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), L.identify("text", model).alias("language"))


@query
def language_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against languages told, over the rows that no profile has seen."""
    told = language_id(spark, sf_dir).filter("held_out")
    labels = documents(spark, sf_dir).select("doc_id", "lang")
    return told.join(labels, "doc_id").groupBy("lang", "language").agg(F.count(F.lit(1)).alias("documents"))


@query
def language_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages told by the built-in samples alone."""
    model = L.sample_model(spark)
    return documents(spark, sf_dir).select("doc_id", L.identify("text", model).alias("language"))


@query
def language_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts still to identify when those of one language are known."""
    hashed = documents(spark, sf_dir).withColumn("text_hash", T.text_hash("text"))
    known = hashed.filter("lang = 'en'").groupBy("text_hash").agg(F.min("lang").alias("language"))
    return LC.misses(hashed, known)


@query
def language_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = L.model(L.profile(training(docs)))
    store = shared_folder(spark, "languages")
    return LC.identify_cached(docs, model, store).select("doc_id", "text_hash", "language")


# Embedding


@query
def l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2))
    return vectors.select("vec_id", vector_text(E.l2_normalise(scaled)).alias("vector"))


@query
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = E.hashing_encoder(HASH_DIM)
    docs = E.to_embed(documents(spark, sf_dir).select("doc_id", "text"))
    raw = docs.withColumn("raw", E.raw_vector("text", encoder))
    return raw.select("doc_id", vector_text(E.l2_normalise("raw")).alias("vector"))


@query
def embed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = E.cache_key("text", E.SENTENCE_MODEL)
    return documents(spark, sf_dir).select("doc_id", key.alias("text_sha"))


@query
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts still to embed when those of one language are kept."""
    key = E.cache_key("text", E.SENTENCE_MODEL)
    keyed = E.to_embed(documents(spark, sf_dir)).withColumn("text_sha", key)
    return E.cache_misses(keyed, keyed.filter("lang = 'en'"))


@query
def embed_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding with a store: the second call finds every text kept."""
    docs, store = documents(spark, sf_dir), shared_folder(spark, "vectors")
    encoder = E.hashing_encoder(HASH_DIM)
    E.embed(docs.filter("lang <> 'en'"), encoder, store, key="doc_id")
    vectors = E.embed(docs, encoder, store, key="doc_id")
    return vectors.select("doc_id", "model", "text_sha", vector_text("embedding").alias("vector"))


@query
def embed_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch encoder that fails on every batch of more than one text."""
    whole = E.hashing_encoder(HASH_DIM)

    def make_predict() -> E.Predict:
        predict = whole.make_predict()

        def one_only(texts: np.ndarray) -> np.ndarray:
            if len(texts) > 1:
                raise MemoryError("batch too large")
            return predict(texts)

        return one_only

    docs = E.to_embed(documents(spark, sf_dir).select("doc_id", "text"))
    vectors = E.embed_texts(docs, E.Encoder("one-by-one", HASH_DIM, make_predict), chunk_size=16)
    return vectors.select("doc_id", vector_text("embedding").alias("vector"))


@query
def embed_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embed job from CSV with blank texts to the written vectors."""
    folder = shared_folder(spark, "embed-job")
    blanked = F.when(F.col("language") == "es", "  ").otherwise(F.col("text"))
    CSV.write_csv(clean(spark, sf_dir).withColumn("text", blanked), f"{folder}/clean")
    encoder = E.hashing_encoder(HASH_DIM)
    vectors = jobs.run_embed(spark, f"{folder}/clean", f"{folder}/store", f"{folder}/out", encoder)
    return vectors.select("conversation_id", "model", "text_sha", vector_text("embedding").alias("vector"))


# Exports, built from the documents: every line of a document is one message.


def _lines() -> Column:
    return F.split(F.col("text"), "\n", -1)


def _json_text(c: Column) -> Column:
    """A string as a JSON string."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _object(pairs: list[tuple[str, Column]]) -> Column:
    fields = [F.concat(F.lit(f'"{k}":'), v) for k, v in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def list_export(line_list: Column) -> Column:
    """Message list whose messages come in three forms in turn."""

    def message(line: Column, i: Column) -> Column:
        text = _json_text(line)
        item = _object([("type", F.lit('"text"')), ("text", text)])
        return (
            F.when(i % 3 == 0, _object([("text", text)]))
            .when(i % 3 == 1, F.concat(F.lit('{"content":['), text, F.lit("]}")))
            .otherwise(F.concat(F.lit('{"text":"","content":['), item, F.lit(",7,null]}")))
        )

    return _list(F.transform(line_list, message))


def map_export(line_list: Column) -> Column:
    """Node map with keys in falling order: a string part, a spoken part, a picture part."""

    def node(line: Column, i: Column) -> Column:
        text = _json_text(line)
        kind = F.when(i % 3 == 1, f'"{J.AUDIO_PART}"').otherwise('"image"')
        part = F.when(i % 3 == 0, text).otherwise(
            _object([("content_type", kind), ("text", text)])
        )
        key = F.concat(F.lit('"n'), (F.lit(900_000) - i).cast("string"), F.lit('":'))
        body = F.concat(F.lit('{"message":{"content":{"parts":['), part, F.lit("]}}}"))
        return F.concat(key, body)

    nodes = F.array_join(F.transform(line_list, node), ",")
    return F.concat(F.lit('{"root":{"message":null},'), nodes, F.lit("}"))


def _extracted(rows: DataFrame) -> DataFrame:
    found = with_once(rows, {"x": J.extract("raw")})
    return found.select("doc_id", "x.text", "x.reject")


@query
def extract_list_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _object([("title", F.lit('"t"')), (J.LIST_KEY, list_export(_lines()))])
    return _extracted(documents(spark, sf_dir).select("doc_id", raw.alias("raw")))


@query
def extract_map_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _object([("title", F.lit('"t"')), (J.MAP_KEY, map_export(_lines()))])
    return _extracted(documents(spark, sf_dir).select("doc_id", raw.alias("raw")))


@query
def extract_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown shape: own text, and a list below of which only the first texts count."""
    items = F.transform(_lines(), lambda line: _object([("content", _json_text(line))]))
    raw = _object(
        [("z", _list(items)), ("text", _json_text(F.get(_lines(), F.lit(0)))), ("n", F.lit("1"))]
    )
    return _extracted(documents(spark, sf_dir).select("doc_id", raw.alias("raw")))


@query
def conversation_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from exports that name themselves differently by language."""
    name = F.concat(F.lit('"d'), F.col("doc_id").cast("string"), F.lit('"'))
    raw = (
        F.when(F.col("lang") == "en", _object([("title", F.lit('"t"')), ("uuid", name)]))
        .when(F.col("lang") == "fr", _object([("id", F.lit('"i"')), ("title", name)]))
        .when(F.col("lang") == "de", _object([("id", name)]))
        .otherwise(_object([("uuid", F.lit("null")), ("title", name)]))
    )
    rows = documents(spark, sf_dir).select(
        "doc_id", raw.alias("raw"), "source", (F.col("doc_id") + 1).alias("pos")
    )
    args = (F.col("raw"), F.col("pos"), F.col("source"))
    return rows.select(
        "doc_id",
        J.conversation_id(*args).alias("id_cli"),
        J.conversation_id(*args, variant="upload").alias("id_upload"),
    )


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an export file: a list, an object, cut-off JSON, or a list
    with a message that is no object, by language."""

    def conversation(line: Column, i: Column) -> Column:
        title = F.concat(F.lit('"line '), i.cast("string"), F.lit('"'))
        messages = F.concat(F.lit('[{"text":'), _json_text(line), F.lit("}]"))
        titled = _object([("title", title), (J.LIST_KEY, messages)])
        return F.when(i % 2 == 0, titled).otherwise(_object([(J.LIST_KEY, messages)]))

    listed = F.transform(_lines(), conversation)
    single = _object([("title", F.lit('"single"')), (J.LIST_KEY, list_export(_lines()))])
    value = (
        F.when(F.col("lang") == "en", _list(listed))
        .when(F.col("lang") == "fr", single)
        .when(F.col("lang") == "de", F.concat(F.lit("[1,"), F.array_join(listed, ",")))
        .otherwise(F.concat(F.lit("[7,"), F.array_join(listed, ","), F.lit("]")))
    )
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".json"))
    return documents(spark, sf_dir).select(name.alias("source_file"), value.alias("value"))


@query
def file_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.flatten(S.split_files(_files(spark, sf_dir)))


@query
def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flattened = jobs.flatten(S.split_files(_files(spark, sf_dir)))
    return jobs.clean_rows(flattened, None).drop("text")


@query
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.reject_rows(jobs.flatten(S.split_files(_files(spark, sf_dir))))


@query
def summary_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest summary with blank and rejected conversations among the rows."""
    flattened = jobs.flatten(S.split_files(_files(spark, sf_dir)))
    s = M.ingest_summary(flattened.withColumn("language", F.lit("unknown")))
    return s.select(
        "total_files_processed",
        "total_conversations",
        "empty_conversations",
        "valid_conversations",
        "rejected_conversations",
        "success_rate",
        F.col("text_length_stats.max").cast("bigint").alias("length_max"),
    )


# Files written and read back


@query
def json_lines_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports as JSON Lines through the whole ingest."""
    folder = shared_folder(spark, "exports")
    name = F.concat(F.lit('"d'), F.col("doc_id").cast("string"), F.lit('"'))
    raw = _object([("uuid", name), (J.LIST_KEY, list_export(_lines()))])
    documents(spark, sf_dir).select(raw.alias("value")).write.text(folder)
    result = jobs.ingest(spark, folder, lines=True, detect=False, pattern="*.txt")
    return result.clean.select("conversation_id", "text", "language")


@query
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean rows written as CSV and read for categorization."""
    folder = shared_folder(spark, "csv")
    CSV.write_csv(clean(spark, sf_dir), folder)
    return CSV.csv_for_categorize(spark, folder).select(*CSV.CLEAN_COLUMNS)


@query
def csv_embed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "csv")
    blanked = F.when(F.col("language") == "es", "  ").otherwise(F.col("text"))
    CSV.write_csv(clean(spark, sf_dir).withColumn("text", blanked), folder)
    return CSV.csv_for_embed(spark, folder).select("conversation_id", "text")


@query
def csv_upload_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uploaded CSV without languages, whose texts are blank or null by language."""
    folder = shared_folder(spark, "csv")
    language = F.col("language")
    text = F.when(language == "es", " ").when(language == "de", "NA").otherwise(F.col("text"))
    rows = clean(spark, sf_dir).withColumn("text", text).drop("language", "source_file")
    CSV.write_csv(rows, folder)
    return CSV.upload_csv_rows(spark, folder).select("conversation_id", "text", "language")


@query
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of JSON exports and of CSV files in one relation, each with its file."""
    flattened = jobs.flatten(S.split_files(_files(spark, sf_dir)))
    both = jobs.clean_rows(flattened, None).select(*CSV.CLEAN_COLUMNS).unionByName(
        clean(spark, sf_dir)
    )
    return both.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("conversations"),
        F.sum(T.char_length("text")).alias("chars"),
    )


@query
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source taken as one uploaded file."""
    name = F.concat("source", F.lit(".json")).alias("name")
    files = documents(spark, sf_dir).groupBy(name).agg(
        F.sum(F.octet_length("text")).alias("bytes")
    )
    return A.admission(files, max_file_bytes=150_000, max_total_bytes=1_000_000)


@query
def categorize_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categorize job from CSV to the written metrics."""
    folder = shared_folder(spark, "job")
    CSV.write_csv(clean(spark, sf_dir), f"{folder}/clean")
    jobs.run_categorize(spark, f"{folder}/clean", f"{folder}/out")
    # what the written rows give must be what the job wrote as metrics
    rows = spark.read.parquet(f"{folder}/out/categorized")
    written = spark.read.json(f"{folder}/out/metrics").select(
        F.col("total_conversations").alias("written_total"),
        F.col("avg_length").alias("written_avg"),
        F.col("performance.rows").alias("written_rows"),
    )
    return cli_fields(M.metrics_cli(rows)).join(written)


@query
def categorized_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categorize job's rows, read back from its CSV."""
    folder = shared_folder(spark, "sink")
    jobs.run_categorize(spark, planted_clean(spark, sf_dir), f"{folder}/out")
    rows = CSV.read_csv(spark, f"{folder}/out/categorized_csv")
    return rows.select(
        "conversation_id",
        "main_category",
        "subcategory",
        (F.col("is_voice") == "true").alias("is_voice"),
        F.col("confidence_score").cast("bigint").alias("confidence_score"),
        F.col("char_length").cast("bigint").alias("char_length"),
        "complexity",
    )


# Conversations in one exported list.
LISTED = 100


def export_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, value``: documents as JSON lists by ``doc_id``; each line of a document is a message."""
    messages = F.transform(_lines(), lambda line: F.struct(line.alias("text")))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("uuid")
    one = F.to_json(F.struct(name, messages.alias(J.LIST_KEY)))
    listed = F.array_sort(F.collect_list(F.struct("doc_id", one.alias("one"))))
    files = documents(spark, sf_dir).groupBy(F.expr(f"doc_id div {LISTED}").alias("file")).agg(listed.alias("listed"))
    items = F.transform("listed", lambda x: x["one"])
    return files.select("file", F.concat(F.lit("["), F.array_join(items, ",\n"), F.lit("]")).alias("value"))


def export_files(lists: DataFrame, folder: str) -> None:
    lists.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(folder)


@query
def ingest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest job over a folder of JSON lists, languages told by the samples."""
    folder = shared_folder(spark, "ingest-job")
    export_files(export_lists(spark, sf_dir), f"{folder}/exports")
    jobs.run_ingest(spark, f"{folder}/exports", f"{folder}/out", pattern="*.txt")
    rows = spark.read.parquet(f"{folder}/out/clean")
    return rows.select("conversation_id", "text", "language", "pos", "text_hash")


@query
def ingest_job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary that the ingest job writes as JSON."""
    folder = shared_folder(spark, "ingest-summary")
    export_files(export_lists(spark, sf_dir), f"{folder}/exports")
    jobs.run_ingest(spark, f"{folder}/exports", f"{folder}/out", pattern="*.txt")
    s = spark.read.json(f"{folder}/out/summary")
    return s.select(
        "total_files_processed",
        "total_conversations",
        "empty_conversations",
        "valid_conversations",
        "rejected_conversations",
        "success_rate",
        F.col("text_length_stats.max").alias("length_max"),
    )


@query
def analyze_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upload analysis of a folder of JSON files and one of CSV without ids and languages."""
    folder = shared_folder(spark, "upload")
    export_files(export_lists(spark, sf_dir), f"{folder}/exports")
    bare = planted_clean(spark, sf_dir).select("text")
    CSV.write_csv(bare, f"{folder}/rows.csv")
    _, metrics = jobs.analyze(spark, [f"{folder}/exports", f"{folder}/rows.csv"], limits=False)
    fields = upload_fields(metrics)
    return fields.drop("files_processed")


@query
def language_unknown_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in letters that no sample has."""
    strange = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувщьъз")
    docs = documents(spark, sf_dir).withColumn("text", F.regexp_replace(strange, "[a-zà-ÿ]", ""))
    model = L.sample_model(spark)
    return docs.select("doc_id", L.identify("text", model).alias("language"))


# Work that goes on from what earlier runs have kept


@query
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far in, read from the one or two ranges that hold it."""
    pages = X.Pages.build(uploaded(spark, sf_dir), "char_length", shared_folder(spark, "pages"), descending=True)
    return pages.page(number=20)


@query
def metrics_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two days, each counted once and kept, merged."""
    rows, kept = categorized(spark, sf_dir), shared_folder(spark, "facts")
    for day in (0, 1):
        M.keep_facts(M.cli_facts(rows.filter(F.col("conversation_id").cast("long") % 2 == day)), kept, f"day-{day}")
    return cli_fields(M.cli_report(M.merged_facts(spark, kept)))


@query
def upload_metrics_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, kept = uploaded(spark, sf_dir), shared_folder(spark, "facts")
    for day in (0, 1):
        M.keep_facts(M.upload_facts(rows.filter(F.col("conversation_id").cast("long") % 2 == day)), kept, f"day-{day}")
    return upload_fields(M.upload_report(M.merged_facts(spark, kept)))


@query
def summary_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, kept = planted_clean(spark, sf_dir), shared_folder(spark, "facts")
    for day in (0, 1):
        M.keep_facts(M.summary_facts(rows.filter(F.col("conversation_id").cast("long") % 2 == day)), kept, f"day-{day}")
    return summary_fields(M.summary_report(M.merged_facts(spark, kept)))


@query
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the categorize job reports of its batches."""
    folder = shared_folder(spark, "throughput")
    jobs.run_categorize(spark, planted_clean(spark, sf_dir), f"{folder}/out", batch_size=64)
    batches = spark.read.parquet(f"{folder}/out/batches")
    reported = spark.read.json(f"{folder}/out/metrics").select(
        F.col("performance.batch_size_used").alias("batch_size"), F.col("performance.batches").alias("reported")
    )
    totals = batches.agg(
        F.sum("rows").alias("rows"),
        F.count_if(F.col("rows") > 64).alias("too_large"),
        F.count_if((F.col("seconds") < 0) | F.col("rows_per_second").isNull()).alias("not_timed"),
        F.count(F.lit(1)).alias("batches"),
    )
    return totals.join(reported).select(
        "rows", "batch_size", "too_large", "not_timed", (F.col("batches") == F.col("reported")).alias("all_reported")
    )


@query
def stage_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each timed stage, from JSON lists to metrics."""
    folder = shared_folder(spark, "stages")
    export_files(export_lists(spark, sf_dir), f"{folder}/exports")
    stages = benchmark.job_stages(spark, f"{folder}/exports", f"{folder}/out", E.hashing_encoder(HASH_DIM), pattern="*.txt")
    return benchmark.report(spark, benchmark.run(stages)).select("stage", "rows", (F.col("seconds") > 0).alias("timed"))


@query
def arriving_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports that arrive in two waves; each run takes what is new, and a batch that is run again changes nothing."""
    folder = shared_folder(spark, "arriving")
    job = watch.Arrivals(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", pattern="*.txt")
    for wave in (0, 1):
        export_files(export_lists(spark, sf_dir).filter(F.col("file") % 2 == wave), f"{folder}/in")
        job.run()
    job.replay()
    return job.rows().select("conversation_id", "main_category", "char_length")
