"""Text embeddings: batched inference in tasks, kept by content.

An encoder is a name, a size and a function that loads the model and returns a
function from an array of texts to a matrix.  It runs once per Python worker and
gets Arrow batches; nothing is shuffled for it.  Encoder functions are closures,
which travel to the workers by value, so the workers need not have this package.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from talkmill.functions import text as T
from talkmill.functions.once import let
from talkmill.sources.store import written
from talkmill.sources.vectors import VectorStore

# Chunk of texts per call and the name of the usual sentence model.
CHUNK_SIZE = 1000
SENTENCE_MODEL = "paraphrase-multilingual-mpnet-base-v2"

Predict = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Encoder:
    """``make_predict`` loads the model, on the worker, and returns its function.

    An encoder that Spark's functions can express has an ``expression`` as well, which is used instead.
    """

    model_name: str
    dim: int
    make_predict: Callable[[], Predict]
    expression: Callable[[Column], Column] | None = None


def hashing_encoder(dim: int = 256) -> Encoder:
    """Signed feature hashing of words; needs no model.

    A word adds +1 or -1 at one position, both taken from its MD5.  The values
    are whole numbers, so they are exact before normalisation.  Spark's own functions
    do it; ``make_predict`` does the same for batches of texts in Python.
    """

    def expression(text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

        def code(digest: Column) -> Column:
            """Even for +1, odd for -1, two numbers for each place."""
            at = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim
            odd = F.substring(digest, 9, 1).isin(*"13579bdf").cast("int")
            return (at * 2 + odd).cast("int")

        def folded(codes: Column) -> Column:
            """Every code stands in the sorted list once more than words have it, so runs begin at known turns."""
            last = F.size(codes) - 1
            new = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(codes, i) != F.get(codes, i - 1)))
            return let(F.concat(new, F.array(last + 1)), signed)

        def signed(starts: Column) -> Column:
            def at(k: Column) -> Column:
                return F.get(starts, k)

            places = F.sequence(F.lit(0), F.lit(2 * dim - 2), F.lit(2))
            return F.transform(places, lambda k: (2 * at(k + 1) - at(k) - at(k + 2)).cast("float"))

        every = F.sequence(F.lit(0), F.lit(2 * dim - 1))
        codes = F.transform(F.transform(words, F.md5), code)
        return let(F.sort_array(F.concat(codes, every)), folded)

    def make_predict() -> Predict:
        @lru_cache(maxsize=100_000)
        def place(word: str) -> tuple[int, int]:
            digest = hashlib.md5(word.encode("utf-8")).hexdigest()
            return int(digest[:8], 16) % dim, 1 if int(digest[8], 16) % 2 == 0 else -1

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in zip(out, texts):
                places = [place(w) for w in re.findall(r"\w+", text.lower())]
                if places:
                    at, sign = np.array(places).T
                    row += np.bincount(at, weights=sign, minlength=dim)
            return out

        return predict

    return Encoder(f"feature-hashing-{dim}", dim, make_predict, expression)


def retrying(make: Callable[[], Predict]) -> Callable[[], Predict]:
    """On a failed batch, try its texts one by one; a text that fails alone fails the task."""

    def make_retrying() -> Predict:
        predict = make()

        def run(texts: np.ndarray) -> np.ndarray:
            try:
                return predict(texts)
            except Exception:
                if len(texts) == 1:
                    raise
                return np.vstack([predict(texts[i : i + 1]) for i in range(len(texts))])

        return run

    return make_retrying


def l2_normalise(vector: Column | str) -> Column:
    """A vector scaled to length 1, in doubles; a zero vector stays as it is."""
    v = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double"))
    with_norm = F.struct(
        v.alias("v"),
        F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)).alias("norm"),
    )

    def scale(s: Column) -> Column:
        scaled = F.transform(s["v"], lambda x: x / s["norm"])
        return F.when(s["norm"] > 0, scaled).otherwise(s["v"])

    return let(with_norm, scale)


def raw_vector(text: Column | str, encoder: Encoder, chunk_size: int = CHUNK_SIZE) -> Column:
    """The encoder's vector of a text, not yet normalised."""
    given = F.col(text) if isinstance(text, str) else text
    if encoder.expression:
        return encoder.expression(given)
    udf = predict_batch_udf(
        retrying(encoder.make_predict),
        return_type=ST.ArrayType(ST.FloatType()),
        batch_size=chunk_size,
    )
    return udf(given)


def cache_key(text: Column | str, model_name: str) -> Column:
    """SHA-256 over model and text: what the text's embedding is kept under."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.concat(F.lit(f"{model_name}|"), text), 256)


def to_embed(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with any text; null is no text."""
    return df.filter(F.col(text).isNotNull() & ~T.is_blank(text))


def embed_texts(
    df: DataFrame, encoder: Encoder, text: str = "text", chunk_size: int = CHUNK_SIZE
) -> DataFrame:
    """Add ``embedding``, of length 1, to every row; row-local."""
    vectors = df.withColumn("__raw", raw_vector(text, encoder, chunk_size))
    unit = l2_normalise("__raw").cast("array<float>")
    return vectors.withColumn("embedding", unit).drop("__raw")


def cache_misses(keyed: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """``text_sha`` and text of each distinct text not kept yet.

    Hashes alone are compared first; texts move only if their hash is missing, and copies are merged
    inside each task before the shuffle.
    """
    hashes = keyed.select("text_sha").distinct()
    return _texts_of(keyed, hashes.join(known.select("text_sha"), "text_sha", "left_anti"), text)


def _texts_of(keyed: DataFrame, missing: DataFrame, text: str) -> DataFrame:
    return (
        keyed.select("text_sha", text)
        .join(missing, "text_sha", "left_semi")
        .groupBy("text_sha")
        .agg(F.any_value(text).alias(text))
    )


def embed(
    df: DataFrame,
    encoder: Encoder,
    store: str,
    *,
    key: str = "conversation_id",
    text: str = "text",
    chunk_size: int = CHUNK_SIZE,
) -> DataFrame:
    """``key, model, text_sha, embedding`` of every row with text.

    Vectors are kept in ``store`` by content and model; only texts not seen before
    are run through the encoder.  The store's bitmaps tell most new hashes; its keys are read only for the
    others, and not at all if there are none.  The final join carries keys and hashes, not
    texts, and AQE splits the partition of a text that many rows share.
    """
    kept = VectorStore(df.sparkSession, store)
    keyed = to_embed(df, text).withColumn("text_sha", cache_key(text, encoder.model_name))
    mine = F.col("model") == encoder.model_name
    held = kept.vectors().filter(mine)

    asked = keyed.select("text_sha").distinct()
    new = asked
    if kept.folders:
        asked = written(kept.perhaps_known(asked, encoder.model_name), "asked")
        new = asked.filter("not perhaps").select("text_sha")
        perhaps = asked.filter("perhaps").select("text_sha")
        if perhaps.isEmpty():
            held = held.limit(0)
        else:
            new = new.union(perhaps.join(held.select("text_sha"), "text_sha", "left_anti"))
    vectors = embed_texts(_texts_of(keyed, new, text), encoder, text, chunk_size)
    before = list(kept.folders)
    kept.add(vectors.select("text_sha", "embedding", F.lit(encoder.model_name).alias("model")))
    added = kept.vectors([f for f in kept.folders if f not in before]).filter(mine)
    wanted = held.join(asked.select("text_sha"), "text_sha", "left_semi") if before else held
    found = keyed.select(key, "text_sha").join(wanted.unionByName(added), "text_sha", "left")
    lost = F.raise_error(F.concat(F.lit("no vector kept for "), F.col("text_sha")))
    return found.select(
        key,
        F.coalesce("model", lost.cast("string")).alias("model"),
        "text_sha",
        "embedding",
    )
