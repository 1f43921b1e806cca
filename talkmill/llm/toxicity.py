"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals make document scores.

Labels are per document, so tokens are labelled from them: words of toxic training texts that are much
more frequent there than in clean ones. The field has two tags, token features (word, prefix, suffix, length,
hashed) and tag transitions. Its likelihood is raised by full gradients that Spark tasks sum over the
training sample; forward-backward runs on blocks of tokens, vectorised over all blocks of a batch. A
logistic function of the marginals' sum, maximum and density, fitted on the same sample, is the score.

The sample is bounded by TOXIC and CLEAN documents, the least by hash of their id, from rows whose
crc32(id) mod 3 is not 1; a document with several labels is toxic if one says so. Every text is scored, whole: what
stands between white space is a token, and one of more than WORDS words is several, of WORDS words each.
Null and empty texts have no tokens and get the score of an empty text; rows that repeat get equal
results; rows without an id are never learned from. Without both kinds of labels every score is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill.llm.components import written
from talkmill.llm.rows import narrow

TOXIC, CLEAN = 1500, 2500
DIMENSIONS = 1 << 15
ROUNDS = 15
#: A word marks toxic tokens if seen in so many toxic documents and so much likelier there (log odds).
LEAST_SEEN, LEAST_ODDS, MOST_WORDS = 3, 2.5, 2000
PREDICTED = 0.7
BLOCK = 32
WORDS = 8
TOGETHER = 2_000_000
CACHED = 200_000

_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\S+")


def _cuts(token: str) -> list[tuple[int, int]]:
    """Where the tokens begin and end in what stands between white space: a new one with each WORDS words."""
    if len(token) <= 2 * WORDS:  # too short for more words
        return [(0, len(token))]
    edges = [0, *[m.start() for m in _WORD.finditer(token)][WORDS::WORDS], len(token)]
    return list(zip(edges, edges[1:], strict=False))


def tokens_of(text: str) -> list[str]:
    """The text's tokens in lower case."""
    found = text.split()
    if max(map(len, found), default=0) <= 2 * WORDS:
        return text.lower().split()
    out = []
    for t in found:
        if len(t) <= 2 * WORDS:
            out.append(t.lower())
        else:
            out += [t[a:z].lower() for a, z in _cuts(t)]
    return out


_AS_WORD, _AS_START, _AS_END = (zlib.crc32(kind) for kind in (b"w", b"p", b"s"))
_LENGTHS = [zlib.crc32(f"l{n}".encode()) % DIMENSIONS for n in range(21)]


def word_features(word: str) -> tuple[int, int, int]:
    """Hashed features of one word: itself, its first four characters, its last three."""
    raw = word.encode("utf-8", "surrogatepass")
    if len(raw) == len(word):
        start, end = raw[:4], raw[-3:]
    else:
        start, end = word[:4].encode("utf-8", "surrogatepass"), word[-3:].encode("utf-8", "surrogatepass")
    return zlib.crc32(raw, _AS_WORD) % DIMENSIONS, zlib.crc32(start, _AS_START) % DIMENSIONS, zlib.crc32(end, _AS_END) % DIMENSIONS


def features(token: str) -> list[int]:
    """Hashed features of one token, in lower case."""
    return [*chain.from_iterable(map(word_features, _WORD.findall(token))), _LENGTHS[min(len(token), 20)]]


@dataclass
class Field:
    """Weights: of features for the toxic tag (the other tag's are 0), and of transitions [from, to]."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))


def marginals(emission: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every token and the expected count of each transition, over sequences laid end to end.

    Sequences are cut into blocks of BLOCK steps, padded with steps that change nothing. Products of each
    block's step matrices give the state at block borders, sequence by sequence; then all blocks run at once.
    """
    out, pairs = np.zeros(len(emission)), np.zeros((2, 2))
    used = np.flatnonzero(lengths)
    if not len(used):
        return out, pairs
    lengths = lengths[used]
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    count = int(blocks.sum())
    starts = np.cumsum(lengths) - lengths
    spot = np.arange(len(emission)) - np.repeat(starts, lengths) + np.repeat(first * BLOCK, lengths)
    step = np.exp(transitions - transitions.max())
    shift = np.maximum(emission, 0)
    node = np.ones((count * BLOCK, 2))
    node[spot, 0], node[spot, 1] = np.exp(-shift), np.exp(emission - shift)
    real = np.zeros(count * BLOCK, np.bool_)
    real[spot] = True
    matrix = np.where(real[:, None, None], step[None] * node[:, None, :], np.eye(2)[None])
    head = first * BLOCK
    matrix[head] = node[head][:, None, :]  # a first token has no transition
    matrix = matrix.reshape(count, BLOCK, 2, 2)
    product = np.broadcast_to(np.eye(2), (count, 2, 2)).copy()
    for k in range(BLOCK):
        product = product @ matrix[:, k]
        product /= product.sum(axis=(1, 2), keepdims=True)
    before, after = np.empty((count, 2)), np.empty((count, 2))
    order = np.argsort(-blocks, kind="stable")
    row, col = np.full((len(order), 2), 0.5), np.ones((len(order), 2))
    for k in range(int(blocks.max())):
        live = int(np.searchsorted(-blocks[order], -k, side="left"))
        at, end = first[order[:live]] + k, first[order[:live]] + blocks[order[:live]] - 1 - k
        before[at] = row[:live]
        row[:live] = np.einsum("ni,nij->nj", row[:live], product[at])
        row[:live] /= row[:live].sum(axis=1, keepdims=True)
        after[end] = col[:live]
        col[:live] = np.einsum("nij,nj->ni", product[end], col[:live])
        col[:live] /= col[:live].sum(axis=1, keepdims=True)
    ahead, behind = np.empty((count, BLOCK, 2)), np.empty((count, BLOCK, 2))
    state, back = before, after
    for k in range(BLOCK):
        state = np.einsum("ni,nij->nj", state, matrix[:, k])
        state = state / state.sum(axis=1, keepdims=True)
        ahead[:, k] = state
        behind[:, BLOCK - 1 - k] = back
        back = np.einsum("nij,nj->ni", matrix[:, BLOCK - 1 - k], back)
        back = back / back.sum(axis=1, keepdims=True)
    both = ahead * behind
    both /= both.sum(axis=2, keepdims=True)
    out[:] = both.reshape(-1, 2)[spot, 1]
    flat_ahead, flat_behind = ahead.reshape(-1, 2), behind.reshape(-1, 2)
    later = spot[np.flatnonzero(np.arange(len(spot)) != np.repeat(starts, lengths))]
    joint = flat_ahead[later - 1][:, :, None] * matrix.reshape(-1, 2, 2)[later] * flat_behind[later][:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    pairs += joint.sum(axis=0)
    return out, pairs


def _in_parts(texts: list[str]):
    """Consecutive runs of texts with about TOGETHER characters, so that few tokens are held at a time."""
    start = size = 0
    for n, text in enumerate(texts):
        size += len(text)
        if size >= TOGETHER:
            yield slice(start, n + 1)
            start, size = n + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def training_sample(df: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """(text, toxic) of at most so many labelled documents of each kind."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    marks = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    by = F.xxhash64("doc_id")
    chosen = marks.filter("toxic = 1").orderBy(by, "doc_id").limit(toxic).union(marks.filter("toxic = 0").orderBy(by, "doc_id").limit(clean))
    # bounded by toxic + clean rows of two numbers
    return df.join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _lexicon(sample: DataFrame, toxic: int, clean: int) -> set[str]:
    def task(batches):
        import pandas as pd

        for batch in batches:
            words: dict[str, list[int]] = {}
            for text, mark in zip(batch["text"], batch["toxic"], strict=True):
                for word in set(_WORD.findall(text.lower())):
                    words.setdefault(word, [0, 0])[mark] += 1
            yield pd.DataFrame([(w, b, a) for w, (a, b) in words.items()], columns=["word", "bad", "good"])

    seen = sample.mapInPandas(task, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    kept = seen.withColumn("odds", odds).filter((F.col("bad") >= max(LEAST_SEEN, toxic // 100)) & (F.col("odds") >= LEAST_ODDS))
    return {r.word for r in kept.orderBy(F.desc("odds"), "word").limit(MOST_WORDS).collect()}


def _gradient(sample: DataFrame, now: Field, lexicon: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the sample: of features and transitions, labelled minus expected."""

    def task(batches):
        import pandas as pd

        total, pairs = np.zeros(DIMENSIONS), np.zeros((2, 2))
        for batch in batches:
            texts = batch["text"].tolist()
            for part in _in_parts(texts):
                tokens = [tokens_of(text) for text in texts[part]]
                number: dict[str, int] = {}
                ids = np.array([number.setdefault(t, len(number)) for row in tokens for t in row], np.int64)
                if not len(ids):
                    continue
                owned = [features(t) for t in number]
                sizes = np.array([len(f) for f in owned])
                flat = np.concatenate(owned).astype(np.int64)
                emission = np.add.reduceat(now.weights[flat], np.cumsum(sizes) - sizes)
                marked = np.array([any(w in lexicon for w in _WORD.findall(t)) for t in number])
                lengths = np.array([len(row) for row in tokens])
                truth = marked[ids] & (np.repeat(batch["toxic"].to_numpy()[part], lengths) == 1)
                chance, expected = marginals(emission[ids], lengths, now.transitions)
                gap = np.bincount(ids, truth - chance, len(number))
                total += np.bincount(flat, np.repeat(gap, sizes), DIMENSIONS)
                first = np.zeros(len(ids), np.bool_)
                first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
                left, right = truth[:-1][~first[1:]].astype(int), truth[1:][~first[1:]].astype(int)
                pairs += np.bincount(left * 2 + right, minlength=4).reshape(2, 2) - expected
        yield pd.DataFrame({"gradient": [np.r_[total, pairs.ravel()].tobytes()]})

    rows = sample.mapInPandas(task, "gradient binary").collect()  # one vector for each task of a bounded sample
    whole = sum((np.frombuffer(r.gradient) for r in rows), np.zeros(DIMENSIONS + 4))
    return whole[:DIMENSIONS], whole[DIMENSIONS:].reshape(2, 2)


def train_field(sample: DataFrame, toxic: int, clean: int, rounds: int = ROUNDS) -> Field:
    """Adaptive gradient ascent on the conditional likelihood, with a small quadratic penalty."""
    lexicon = _lexicon(sample, toxic, clean)
    now, squares, pair_squares = Field(), np.full(DIMENSIONS, 1e-6), np.full((2, 2), 1e-6)
    for k in range(rounds):
        gradient, pairs = _gradient(sample, now, lexicon)
        gradient, pairs = gradient - 0.01 * now.weights, pairs - 0.01 * now.transitions
        squares += gradient**2
        pair_squares += pairs**2
        now = Field(now.weights + gradient / np.sqrt(squares), now.transitions + pairs / np.sqrt(pair_squares))
    return now


class Tagger:
    """Marginals of texts under a field; the emission of each distinct token and of each word is kept, within a bound."""

    def __init__(self, now: Field):
        self.now, self.known, self.words = now, {}, {}
        self.weights = now.weights.tolist()

    def emission(self, token: str) -> float:
        words, weights = self.words, self.weights
        total = weights[_LENGTHS[min(len(token), 20)]]
        for word in _WORD.findall(token):
            own = words.get(word)
            if own is None:
                a, b, c = word_features(word)
                own = words[word] = weights[a] + weights[b] + weights[c]
            total += own
        return total

    def __call__(self, texts: list[str]):
        """For each text: its number of tokens and the marginals of its tokens."""
        for part in _in_parts(texts):
            tokens = [tokens_of(text) for text in texts[part]]
            if len(self.known) > CACHED:
                self.known, self.words = {}, {}
            known = self.known
            for token in set().union(*tokens).difference(known):
                known[token] = self.emission(token)
            lengths = np.array([len(row) for row in tokens])
            emission = np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), np.float64, int(lengths.sum()))
            chance, _ = marginals(emission, lengths, self.now.transitions)
            ends = np.cumsum(lengths)
            yield from (chance[end - n : end] for n, end in zip(lengths, ends, strict=True))


def evidence(chance: np.ndarray) -> list[float]:
    """What the score sees of a text's marginals."""
    if not len(chance):
        return [0.0, 0.0, 0.0]
    total = float(chance.sum())
    return [math.log1p(total), float(chance.max()), 100 * total / (len(chance) + 10)]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps with a small penalty."""
    x = np.c_[x, np.ones(len(x))]
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 1e-2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + eye, x.T @ (y - p) - eye @ w)
    return w


def _evidence_of(sample: DataFrame, now: Field) -> tuple[np.ndarray, np.ndarray]:
    def task(batches):
        import pandas as pd

        tagger = Tagger(now)
        for batch in batches:
            rows = [evidence(chance) for chance in tagger(batch["text"].tolist())]
            yield pd.DataFrame(rows, columns=["a", "b", "c"]).assign(toxic=batch["toxic"].to_numpy())

    rows = sample.mapInPandas(task, "a double, b double, c double, toxic int").toPandas()  # of the bounded sample
    return rows[["a", "b", "c"]].to_numpy(), rows["toxic"].to_numpy()


def _offsets(text: str, chance: np.ndarray) -> str:
    """start:end in code points of runs of tokens likelier toxic than not, comma-joined."""
    if not (chance >= 0.5).any():
        return ""
    spans, last = [], -2
    places = ((m.start() + a, m.start() + z) for m in _TOKEN.finditer(text) for a, z in _cuts(m.group()))
    for k, (start, end) in enumerate(places):
        if chance[k] >= 0.5:
            if last == k - 1:
                spans[-1][1] = end
            else:
                spans.append([start, end])
            last = k
    return ",".join(f"{a}:{b}" for a, b in spans)


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """(doc_id, score, spans): every row's score and the offsets of its toxic runs of tokens."""
    docs = narrow(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sample = written(training_sample(docs, labels, toxic, clean).repartition(12), "toxic-sample")
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit("").alias("spans"))
    now = train_field(sample, counts[1], counts[0])
    weights = fit_logistic(*_evidence_of(sample, now))
    # DIMENSIONS numbers; plain arrays, as a broadcast's classes would have to be importable by executors
    model = docs.sparkSession.sparkContext.broadcast((now.weights, now.transitions, weights))

    def task(batches):
        import pandas as pd

        *field_parts, weights = model.value
        tagger = Tagger(Field(*field_parts))
        for batch in batches:
            texts = batch["text"].tolist()
            score, spans = [], []
            for text, chance in zip(texts, tagger(texts), strict=True):
                z = float(np.dot(weights[:-1], evidence(chance)) + weights[-1])
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                spans.append(_offsets(text, chance))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score, "spans": spans})

    return docs.mapInPandas(task, "doc_id long, score double, spans string")


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; held_out rows were never learned from."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    scored = score_toxicity(docs, labels.select("doc_id", "toxic"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"), "spans")
