"""Quality classifier from weak labels: heuristic labellers vote, expectation-maximisation weighs them, a linear scorer learns.

Each labeller votes junk, clean or abstains on a whole text. The counts of vote patterns over all texts
(at most 3 ** labellers rows) go to the driver, where expectation-maximisation estimates how
often each labeller is right when it votes, with no true label. Its posteriors label all texts, copies of one
once, and on all of them a logistic scorer over hashed token features is trained by full gradients that tasks sum.
Texts are split into words once: votes and features are written, and what follows reads them from there. Every
text gets the scorer's score; texts under KEEP are rejected.

Null and empty texts have no tokens: every labeller abstains and the score is that of an empty text. Rows that
repeat get equal results. An empty table has no rows to score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill.llm.components import written
from talkmill.llm.rows import narrow, row_key, text_or_empty

#: Texts that a gradient counts as at most, so that steps and regularisation are alike for tables of any size.
STRENGTH = 8000
DIMENSIONS = 1 << 16
ROUNDS = 20
KEEP = 0.5
CACHED = 300_000
RUN = 100
PIECE = 40
#: Features that are looked up at a time, and shares that gradients are added up by.
TOGETHER, SHARES = 1_000_000, 8
JUNK, ABSTAIN, CLEAN = 0, 1, 2

#: Classes of the first 256 code points: letter in lower case or caseless, upper case, digit, white space, other; the rest are letters.
_KINDS = np.array([1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4 for c in map(chr, range(256))], np.uint8)


class Lexicon:
    """Distinct words by number, with what labellers and, if asked for, the scorer look at in each; emptied beyond CACHED words."""

    def __init__(self, scored: bool = True):
        self.scored = scored
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        #: Length, ends a sentence, plain, ends in one symbol twice, separator; then hashed word, shape and end.
        self.table = np.zeros((1024, 8), np.int32)

    def numbers(self, words: list[str]) -> np.ndarray:
        number = self.number
        if len(number) > CACHED:
            self._clear()
            number = self.number
        new = list(set(words).difference(number))
        if new:
            first, end = len(number), len(number) + len(new)
            number.update(zip(new, range(first, end), strict=True))
            while end > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first:end, :5] = [_looks(word) for word in new]
            if self.scored:
                self.table[first:end, 5:] = [_features(word) if len(word) <= PIECE else (-1, -1, -1) for word in new]
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _looks(word: str) -> tuple[int, bool, bool, bool, bool]:
    size, last = len(word), word[-1]
    if word.isalpha():
        return size, False, True, False, False
    return (
        size,
        last in ".?!",
        word[:-1].isalpha(),
        size > 2 and last == word[-2] and not last.isalnum(),
        size < 4 and not any(map(str.isalnum, word)),
    )


class Measures:
    """What the labellers look at."""

    def __init__(self, text: str, lexicon: Lexicon | None = None):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.bincount(_KINDS[np.minimum(points, 255)][points < 256], minlength=5)
        self.chars = max(1, len(points))
        self.letters = max(1, int(kinds[0] + kinds[1] + (points >= 256).sum()))
        self.upper, self.digits, self.symbols = int(kinds[1]), int(kinds[2]), int(kinds[4])
        self.words = text.split()
        lexicon = lexicon or Lexicon(scored=False)
        self.numbers = numbers = lexicon.numbers(self.words)
        looks = lexicon.table[numbers, :5].sum(axis=0, dtype=np.int64).tolist()
        self.size, self.sentence_ends, self.plain, self.symbol_runs, self.separators = looks
        self.same = int((numbers[1:] == numbers[:-1]).sum())
        #: Distinct words of each run of RUN words, summed over all runs.
        runs = np.sort(numbers[: len(numbers) // RUN * RUN].reshape(-1, RUN), axis=1)
        self.fresh = int((runs[:, 1:] != runs[:, :-1]).sum()) + len(runs) + len(set(numbers[runs.size :].tolist()))
        self.lines = [line for line in text.split("\n") if line.strip()]


def _over(value: float, limit: float) -> int:
    """A detector of one kind of junk: blind to others, it never votes clean."""
    return JUNK if value > limit else ABSTAIN


def symbols(m: Measures) -> int:
    return _over(m.symbols / m.chars, 0.07) if len(m.words) >= 10 else ABSTAIN


def symbol_runs(m: Measures) -> int:
    """Words that end in one symbol twice."""
    if len(m.words) < 5:
        return ABSTAIN
    return _over(m.symbol_runs / len(m.words), 0.1)


def capitals(m: Measures) -> int:
    return _over(m.upper / m.letters, 0.25) if len(m.words) >= 10 else ABSTAIN


def digits(m: Measures) -> int:
    return _over(m.digits / m.chars, 0.2) if len(m.words) >= 10 else ABSTAIN


def repeats(m: Measures) -> int:
    """Words equal to the one before."""
    if len(m.words) < 10:
        return ABSTAIN
    return _over(m.same / len(m.words), 0.1)


def variety(m: Measures) -> int:
    """Few distinct words among each hundred, so length does not count."""
    if len(m.words) < 20:
        return ABSTAIN
    return _over(1 - m.fresh / len(m.words), 0.5)


def line_copies(m: Measures) -> int:
    return _over(1 - len(set(m.lines)) / len(m.lines), 0.35) if len(m.lines) >= 4 else ABSTAIN


def separators(m: Measures) -> int:
    """Words without a letter or digit, as between the items of a menu."""
    if len(m.words) < 5:
        return ABSTAIN
    return _over(m.separators / len(m.words), 0.1)


def _sentence_share(m: Measures) -> float:
    return m.sentence_ends / max(1, len(m.words))


def sentences(m: Measures) -> int:
    """Words that end a sentence: none, or nearly all."""
    return JUNK if len(m.words) >= 20 and not 0.02 <= _sentence_share(m) <= 0.3 else ABSTAIN


def prose(m: Measures) -> int:
    """Sentences with the punctuation of prose and changing words; anything else says nothing."""
    usual = len(m.words) >= 10 and 0.02 <= _sentence_share(m) <= 0.4 and m.symbols / m.chars <= 0.05
    return CLEAN if usual and m.fresh >= 0.6 * len(m.words) else ABSTAIN


def plain_words(m: Measures) -> int:
    """Words of usual length, nearly all of them letters but for a mark at the end, changing, in lines that differ."""
    if len(m.words) < 3:
        return ABSTAIN
    size, plain = m.size / len(m.words), m.plain / len(m.words)
    return CLEAN if 2.5 <= size <= 9 and plain >= 0.9 and m.fresh > 0.5 * len(m.words) and len(set(m.lines)) > 0.6 * len(m.lines) else ABSTAIN


LABELLERS: tuple[Callable[[Measures], int], ...] = (
    symbols, symbol_runs, capitals, digits, repeats, variety, line_copies, separators, sentences, prose, plain_words,
)


def pattern(text: str | Measures, labellers=LABELLERS) -> int:
    """The votes as one number in base three."""
    m, code = Measures(text) if isinstance(text, str) else text, 0
    for labeller in labellers:
        code = code * 3 + labeller(m)
    return code


def votes_of(code: int, count: int = len(LABELLERS)) -> list[int]:
    out = []
    for _ in range(count):
        code, vote = divmod(code, 3)
        out.append(vote)
    return out[::-1]


class LabelModel:
    """Expectation-maximisation over vote patterns: a labeller that votes is right at its own rate, whatever the class."""

    def __init__(self, counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 200):
        codes = sorted(counts)
        votes = np.array([votes_of(c, labellers) for c in codes]).reshape(len(codes), labellers)
        weight = np.array([counts[c] for c in codes], float)
        junk, clean = votes == JUNK, votes == CLEAN
        self.prior, self.right = 0.9, np.full(labellers, 0.95)  # of a clean text; of each labeller
        for _ in range(rounds):
            after, old = self._posterior(junk, clean), self.right
            self.prior = float(np.clip((weight @ after + 9) / (weight.sum() + 10), 0.05, 0.95))
            agreed = (weight * after) @ clean + (weight * (1 - after)) @ junk
            self.right = np.clip((agreed + 19) / (weight @ (junk | clean) + 20), 0.6, 0.995)
            if np.abs(old - self.right).max() < 1e-9:
                break
        self.posterior = dict(zip(codes, self._posterior(junk, clean).tolist(), strict=True))

    def _posterior(self, junk: np.ndarray, clean: np.ndarray) -> np.ndarray:
        """P(clean) of each pattern; a labeller that abstains says nothing."""
        z = math.log(self.prior / (1 - self.prior)) + (clean.astype(int) - junk) @ np.log(self.right / (1 - self.right))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Kinds(dict):
    """Code points to A, a, 0 for letters and digits, others to themselves."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


_KIND_OF, _LONG_RUN = _Kinds(), re.compile(r"(.)\1{3,}", re.DOTALL)


def _shape(word: str) -> str:
    """The word's pattern of letters, digits and others, runs cut to three."""
    body = word if word[-1].isalnum() else word[:-1]
    if body.isalpha() and body.islower():
        return "aaa"[: len(body)] + word[len(body) :]
    return _LONG_RUN.sub(r"\1\1\1", word.translate(_KIND_OF))


_AS_WORD, _AS_SHAPE, _AS_END = (zlib.crc32(kind) for kind in (b"w", b"s", b"e"))


def _features(word: str) -> tuple[int, int, int]:
    """Hashes of a word, of its shape and of its end."""
    raw, shape = word.encode("utf-8", "surrogatepass"), _shape(word).encode("utf-8", "surrogatepass")
    end = raw[-2:] if len(raw) == len(word) else word[-2:].encode("utf-8", "surrogatepass")
    return zlib.crc32(raw, _AS_WORD) % DIMENSIONS, zlib.crc32(shape, _AS_SHAPE) % DIMENSIONS, zlib.crc32(end, _AS_END) % DIMENSIONS


class Hasher:
    """Texts to sparse features: words, their shapes, their ends, and whether a word repeats the one before.

    A word of more than PIECE characters is as many words of PIECE characters, and a rest, as it takes.
    """

    def __init__(self, lexicon: Lexicon | None = None):
        self.lexicon = lexicon or Lexicon()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        return self.of_words(words, self.lexicon.numbers(words))

    def of_words(self, words: list[str], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of words and their numbers in the lexicon."""
        ids, counts, size = self.counted(words, numbers)
        return ids, np.sqrt(counts / size)

    def counted(self, words: list[str], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Features in ascending order, how often each occurs, and the number of words."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64), 1
        rows = self.lexicon.table[numbers, 5:]
        if (rows[:, 0] < 0).any():
            words = [w[k : k + PIECE] for w in words for k in range(0, len(w), PIECE)]
            numbers = self.lexicon.numbers(words)
            rows = self.lexicon.table[numbers, 5:]
        same = int((numbers[1:] == numbers[:-1]).sum())
        ids, counts = np.unique(np.append(rows.ravel(), np.full(same, zlib.crc32(b"same") % DIMENSIONS)), return_counts=True)
        return ids, counts, len(words)


def _packed(numbers: np.ndarray) -> bytes:
    """Small whole numbers, each as the bytes of value 255 that it holds and one byte for the rest."""
    full, rest = np.divmod(numbers, 255)
    out = np.full(int(full.sum()) + len(full), 255, np.uint8)
    out[np.cumsum(full + 1) - 1] = rest
    return out.tobytes()


def _unpacked(cells) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all cells end to end, and how many each cell has."""
    raw = np.frombuffer(b"".join(cells), np.uint8)
    ends = np.flatnonzero(raw != 255)
    reached = np.append(0, np.cumsum(raw, dtype=np.int64)[ends])
    cells_end = np.searchsorted(ends, np.cumsum([len(cell) for cell in cells]))
    return np.diff(reached), np.diff(cells_end, prepend=0)


def _looked_at(docs: DataFrame) -> DataFrame:
    """(key, doc_id, same, pattern, words, ids, counts): votes and features of each text, written for all passes over them; equal texts have equal same.

    Ids are ascending; steps from one to the next are written, which are small.
    """

    def task(batches):
        import pandas as pd

        lexicon = Lexicon()
        hasher = Hasher(lexicon)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                m = Measures(text, lexicon)
                ids, counts, size = hasher.counted(m.words, m.numbers)
                rows.append((pattern(m), size, _packed(np.diff(ids, prepend=0)), _packed(counts)))
            found = pd.DataFrame(rows, columns=["pattern", "words", "ids", "counts"])
            yield pd.concat([batch[["key", "doc_id", "same"]].reset_index(drop=True), found], axis=1)

    texts = docs.select("key", "doc_id", F.unhex(F.md5("text")).alias("same"), "text")
    return written(texts.mapInPandas(task, "key string, doc_id long, same binary, pattern int, words long, ids binary, counts binary"), "quality-features")


def _features_of(batches) -> Iterator[tuple]:
    """(rows of a batch, ids, values, places of their texts) for about TOGETHER features at a time; rows without a number of words hold ids and values as they are."""
    for batch in batches:
        share = np.cumsum(batch["ids"].map(len).to_numpy(np.int64)) // TOGETHER
        for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(share)) + 1):
            part = batch.iloc[rows]
            if "words" in batch:
                steps, sizes = _unpacked(part["ids"].tolist())
                text = np.repeat(np.arange(len(part)), sizes)
                reached = np.append(0, np.cumsum(steps))
                ids = reached[1:] - reached[np.cumsum(sizes) - sizes][text]
                values = np.sqrt(_unpacked(part["counts"].tolist())[0] / part["words"].to_numpy()[text])
            else:
                ids, values = np.frombuffer(b"".join(part["ids"]), np.int64), np.frombuffer(b"".join(part["counts"]))
                text = np.repeat(np.arange(len(part)), part["ids"].map(len).to_numpy(np.int64) // 8)
            yield part, ids, values, text


def _scores(weights: np.ndarray, bias: float, ids: np.ndarray, values: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    z = np.bincount(text, weights[ids] * values, minlength=texts) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(labelled: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and intercept by adaptive gradient ascent on the expected log-likelihood of the posteriors.

    A gradient meets by shares, so the driver gets DIMENSIONS numbers a round, however many tasks there are.
    """
    context = labelled.sparkSession.sparkContext
    rows = labelled.coalesce(context.defaultParallelism)  # each task gives DIMENSIONS numbers
    weights, squares, bias, bias_squares = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-3), 0.0, 1e-3
    edges = np.linspace(0, DIMENSIONS + 2, SHARES + 1).astype(int).tolist()

    def added(parts):
        import pandas as pd

        whole = sum(np.frombuffer(part) for part in parts["part"])
        return pd.DataFrame({"share": parts["share"].iloc[:1], "part": [whole.tobytes()]})

    for _ in range(rounds):
        sent = context.broadcast((weights, bias))

        def task(batches, sent=sent):
            import pandas as pd

            now, at = sent.value
            total = np.zeros(DIMENSIONS + 2)  # last the intercept's slope and the texts
            for part, ids, values, text in _features_of(batches):
                gap = part["posterior"].to_numpy() - _scores(now, at, ids, values, text, len(part))
                total[:DIMENSIONS] += np.bincount(ids, gap[text] * values, minlength=DIMENSIONS)
                total[DIMENSIONS:] += gap.sum(), len(part)
            parts = [total[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:], strict=True)]
            yield pd.DataFrame({"share": range(SHARES), "part": parts})

        shares = rows.mapInPandas(task, "share int, part binary").groupBy("share").applyInPandas(added, "share int, part binary")
        whole = np.concatenate([np.frombuffer(r.part) for r in sorted(shares.collect(), key=lambda r: r.share)])  # DIMENSIONS + 2 numbers
        whole = whole[:-1] * min(1.0, STRENGTH / max(1.0, whole[-1]))
        gradient = whole[:-1] - 0.05 * weights
        squares += gradient**2
        bias_squares += whole[-1] ** 2
        weights = weights + gradient / np.sqrt(squares)
        bias += 0.5 * whole[-1] / math.sqrt(bias_squares)
        sent.destroy()
    return weights, bias


def score_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, pattern, posterior, score), one row per row of df; key is the row key."""
    docs = df.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    looked = _looked_at(docs)
    counts = {r.pattern: r["count"] for r in looked.groupBy("pattern").count().collect()}  # at most 3 ** labellers
    if not counts:
        return docs.select("key", "doc_id", F.lit(0).alias("pattern"), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"))
    spark = docs.sparkSession
    posterior = F.broadcast(spark.createDataFrame(list(LabelModel(counts).posterior.items()), "pattern int, posterior double"))
    # copies of one text count once: a hot group would be most of the training
    labelled = written(looked.dropDuplicates(["same"]).join(posterior, "pattern").select("words", "ids", "counts", "posterior"), "quality-labelled")
    model = spark.sparkContext.broadcast(_train(labelled))  # DIMENSIONS numbers

    def task(batches):
        weights, bias = model.value
        for part, ids, values, text in _features_of(batches):
            yield part[["key", "doc_id", "pattern", "posterior"]].assign(score=_scores(weights, bias, ids, values, text, len(part)))

    return looked.join(posterior, "pattern").select("key", "doc_id", "pattern", "posterior", "words", "ids", "counts").mapInPandas(task, "key string, doc_id long, pattern int, posterior double, score double")


def keep_clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of df whose text's score is at least keep."""
    rejected = score_quality(df, id_col, text_col).filter(F.col("score") < keep).select("key").distinct()
    rows = df.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key")).join(rejected, "key", "left_anti")
    return rows.select(*(F.col("row").getField(c).alias(c) for c in df.columns))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, posterior and score of every document."""
    scored = score_quality(narrow(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    votes = F.concat(*(F.substring(F.lit("-0+"), (F.floor(F.col("pattern") / 3**k) % 3 + 1).cast("int"), F.lit(1)) for k in range(len(LABELLERS) - 1, -1, -1)))
    return scored.select("doc_id", votes.alias("votes"), "posterior", "score", (F.col("score") >= KEEP).alias("keep"))
