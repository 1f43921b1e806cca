"""Benchmark decontamination by latent semantic search, with rare words beside it so that no copy is missed.

1. Words of the benchmark are the vocabulary; how many documents hold each is counted over all documents.
2. A distributed randomised SVD of TF-IDF passages (all of the benchmark's and of the documents') gives a latent space:
   tasks sum A'AQ, the sums meet by shares of the vocabulary, the driver orthogonalises vocabulary x RANK numbers.
3. Every whole document is cut into overlapping passages. A benchmark passage is a candidate of each document passage whose
   latent cosine with it reaches COSINE, wherever its words stand. Beside this, each benchmark passage has leading words: its rarest, so many
   that the others weigh less than SHARE of it. What holds SHARE holds a leading word, so a benchmark passage is also a
   candidate of all document passages that hold one: copies of items too common for the latent space are not missed.
4. A candidate is a leak if the longest common subsequence of words, weighted by idf, reaches SURE of the benchmark
   passage's weight, or SHARE of it while also ANSWER of its last quarter, the answer, stands in the document's passage;
   for one near in the latent space NEAR of the weight is enough beside the answer, as clauses may have changed places.

Benchmark passages are cut short enough to lie within one document passage, wherever they stand. The benchmark is a stated
query set, taken in blocks of ITEMS; a block is what is broadcast. Documents are split into words once a block, and their
numbers, four bytes a word, are written for the passes that follow. Null and empty texts and items have no words and never
match; rows that repeat give equal results, once per (document, item); an item of several passages leaks if one does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill.llm.components import written
from talkmill.llm.rows import row_key, text_or_empty

PASSAGE, STRIDE = 64, 16
RANK, SPARE, POWERS = 96, 16, 3
SHARE, SURE, ANSWER = 0.6, 0.8, 0.5
COSINE, NEAR = 0.8, 0.4
#: Words whose latent vectors are held at a time, whole steps; shorter documents are put together up to it.
HELD = 16_384
#: Passages that are multiplied at a time, and shares of the vocabulary that products are added up by.
ROWS, SHARES = 64, 32
#: Document passages, and pairs of them and benchmark passages, that are compared at a time.
COMPARED, PAIRS = 64, 20_000
ITEMS = 20_000
#: Pairs of a leading word and a benchmark passage that are held at a time.
TOGETHER = 200_000
#: Pairs whose common subsequences are found together, and words whose latent vectors are summed together, whole steps.
WEIGHED, SUMMED = 256, 2048
#: Characters that are split into words together; a longer text stands alone.
SPLIT = 1 << 20
STRIPPED = ".,;:!?\"'()[]{}<>*#$%&|-_=+/\\`~"


def words_of(text: str) -> list[str]:
    return [w for w in (t.strip(STRIPPED) for t in text.lower().split()) if w]


class Numbers:
    """Words of texts by their vocabulary numbers, -1 for other words; tokens are split and looked up by Arrow."""

    def __init__(self, vocabulary: dict[str, int]):
        import pyarrow as pa

        self.words = pa.array(list(vocabulary), pa.large_string())
        self.numbers = np.append(np.fromiter(vocabulary.values(), np.int32, len(vocabulary)), np.int32(-1))  # last: other words

    def of(self, text: str) -> np.ndarray:
        return self._of_some([text])[0]

    def of_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        some, size = [], 0
        for text in texts:
            if some and size + len(text) > SPLIT:
                yield from self._of_some(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        if some:
            yield from self._of_some(some)

    def _of_some(self, texts: list[str]) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        # Arrow splits at the same characters as Python, but lowers a few letters otherwise; it reads one character beyond
        # blanks, so a token without a word stands behind the last ones
        tokens = pc.utf8_split_whitespace(pa.array([text.lower() + " ." for text in texts], pa.large_string()))
        words = pc.utf8_trim(tokens.values, STRIPPED)
        found = self.numbers[pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()]
        held = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # the others are tokens without a word
        edges = np.append(0, np.cumsum(held))[tokens.offsets.to_numpy()].tolist()
        found = found[held]
        return [found[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)]


class Benchmark:
    """Passages of one block of items, and what retrieval needs to know of them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.item, self.passages = [], []
        most = PASSAGE - STRIDE
        for number, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], np.int32)
            parts = max(1, -(-len(ids) // most))
            for part in np.array_split(ids, parts):
                if len(part):
                    self.item.append(number)
                    self.passages.append(part)

    @classmethod
    def of(cls, state: dict) -> Benchmark:
        """From the attributes, which travel as plain values: executors need not import this class."""
        self = cls([])
        self.__dict__.update(state)
        return self

    def weigh(self, documents: int, frequency: np.ndarray) -> None:
        self.idf = np.log((documents + 1) / (frequency + 1)) + 0.05
        self.unknown = math.log(documents + 1)
        self.mass = np.append(self.idf, 0.0)  # other words, whose number is -1, have none
        weight = np.array([self.idf[p].sum() for p in self.passages])
        order = np.argsort(weight, kind="stable")  # the lightest first: a document passage can hold only the first ones
        self.item, self.passages = [self.item[k] for k in order], [self.passages[k] for k in order]
        self.weight, self.limit = weight[order], weight[order] * SHARE
        self._index()

    def _index(self) -> None:
        """Of all passages end to end the words; of each word the passages that it leads."""
        self.size = np.array([len(p) for p in self.passages])
        self.begin, self.flat = np.cumsum(self.size) - self.size, np.concatenate(self.passages)
        leads = []
        for passage, limit in zip(self.passages, self.limit, strict=True):
            words, counts = np.unique(passage, return_counts=True)
            order = np.argsort(-self.idf[words], kind="stable")
            rest = np.cumsum((counts * self.idf[words])[order][::-1])[::-1]  # of a word and all that are commoner
            leads.append(words[order][rest >= limit - 1e-9])
        led, by = np.concatenate(leads), np.repeat(np.arange(len(leads)), [len(x) for x in leads])
        self.led = by[np.argsort(led, kind="stable")]
        self.leads = np.append(np.bincount(led, minlength=len(self.idf)), 0)  # the last place is that of other words
        self.led_from = np.cumsum(self.leads) - self.leads

    def project(self, basis: np.ndarray) -> None:
        """basis: vocabulary x rank."""
        # a last row of zeros stands for other words
        self.rows = np.vstack([basis * self.idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        latent = np.stack([self.rows[p].sum(axis=0) for p in self.passages])
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)


def _numbered(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(key, doc_id, ids): each document's words by their numbers, written for all passes over them."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches):
        import pyarrow as pa

        numbers = Numbers(sent.value)
        for batch in batches:
            ids = pa.array([ids.tobytes() for ids in numbers.of_all(batch.column("text").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), ids], ["key", "doc_id", "ids"])

    return written(docs.select("key", "doc_id", "text").mapInArrow(task, "key string, doc_id long, ids binary"), "numbered")


def _frequencies(numbered: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """The number of documents, and of those with each of size words."""

    def task(batches):
        import pandas as pd

        seen, rows = np.zeros(size + 1, np.int64), 0
        present = np.zeros(len(seen), np.bool_)  # the last place is that of other words
        for batch in batches:
            for raw in batch["ids"]:
                ids = np.frombuffer(raw, np.int32)
                present[ids] = True
                seen += present
                present[ids] = False
                rows += 1
        seen[-1] = rows  # last: the documents
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"word": at, "seen": seen[at]})

    counted = numbered.select("ids").mapInPandas(task, "word long, seen long").groupBy("word").agg(F.sum("seen").alias("seen"))
    out = np.zeros(size + 1, np.int64)
    for r in counted.collect():  # one row for each word of a block of the benchmark
        out[r.word] = r.seen
    return int(out[-1]), out[:-1]


def _groups(found: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of documents that have words of the vocabulary, of about HELD words together; a longer one stands alone."""
    group, size = [], 0
    for n, ids in enumerate(found):
        if not len(ids) or ids.max() < 0:
            continue
        if group and size + len(ids) > HELD:
            yield group
            group, size = [], 0
        group.append(n)
        size += len(ids)
    if group:
        yield group


def _rows(found: list[np.ndarray], idf: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, word and value of all entries of A, by rows, and the number of rows: of each passage the words' weights in a vector of length 1 over all words."""
    sizes = np.array([len(x) for x in found])
    parts = -(-sizes // PASSAGE)
    rows, other, none = int(parts.sum()), len(idf), len(idf) + 1
    # a line for each passage, filled up with none; sorted, a word's occurrences stand together
    grid, ids = np.full(rows * PASSAGE, none, np.int32), np.concatenate(found)
    grid[_spread((np.cumsum(parts) - parts) * PASSAGE, sizes)] = np.where(ids < 0, other, ids)
    grid = grid.reshape(rows, PASSAGE)
    grid.sort(axis=1)
    others = (grid == other).sum(axis=1) * unknown**2
    flat = grid.ravel()
    first = np.append(True, flat[1:] != flat[:-1])
    first[::PASSAGE] = True
    at = np.flatnonzero(first)
    counts = np.diff(at, append=len(flat))
    known = flat[at] < other
    row, word = at[known] // PASSAGE, flat[at[known]]
    values = counts[known] * idf[word]
    values /= np.sqrt(np.bincount(row, values**2, minlength=rows) + others)[row]
    return row, word, values, rows


def _add_products(total: np.ndarray, found: list[np.ndarray], idf: np.ndarray, unknown: float, q: np.ndarray) -> None:
    """Adds A'AQ to total."""
    row, word, values, rows = _rows(found, idf, unknown)
    edges = np.searchsorted(row, range(0, rows + ROWS, ROWS)).tolist()
    seen, place = np.zeros(len(idf), np.bool_), np.zeros(len(idf), np.intp)
    for k, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < z:
            seen[word[a:z]] = True
            words = np.flatnonzero(seen)
            seen[words], place[words] = False, np.arange(len(words))
            block = np.zeros((ROWS, len(words)), np.float32)
            block[row[a:z] - k * ROWS, place[word[a:z]]] = values[a:z]
            total[words] += block.T @ (block @ q.take(words, axis=0))


def _basis(numbered: DataFrame, bench: Benchmark, rank: int) -> np.ndarray:
    """The leading right singular vectors of the passages, vocabulary x rank."""
    context = numbered.sparkSession.sparkContext
    size = len(bench.idf)
    width = min(size, rank + SPARE)
    q = np.linalg.qr(np.random.default_rng(17).standard_normal((size, width)))[0]
    edges = np.linspace(0, size, SHARES + 1).astype(int).tolist()
    passages = numbered.select("ids").coalesce(2 * context.defaultParallelism)  # each task gives vocabulary x rank numbers
    for _ in range(POWERS):
        sent = context.broadcast((bench.idf, bench.unknown, q.astype(np.float32)))

        def task(batches, sent=sent):
            import pandas as pd

            idf, unknown, q = sent.value
            total = np.zeros(q.shape)
            for batch in batches:
                found = [np.frombuffer(raw, np.int32) for raw in batch["ids"]]
                for group in _groups(found):
                    _add_products(total, [found[n] for n in group], idf, unknown, q)
            parts = [total[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:], strict=True)]
            yield pd.DataFrame({"share": range(SHARES), "part": parts})

        def added(parts):
            import pandas as pd

            whole = sum(np.frombuffer(part) for part in parts["part"])
            return pd.DataFrame({"share": parts["share"].iloc[:1], "part": [whole.tobytes()]})

        shares = passages.mapInPandas(task, "share int, part binary").groupBy("share").applyInPandas(added, "share int, part binary")
        total = np.zeros(q.shape)
        for r in shares.collect():  # vocabulary x rank numbers
            total[edges[r.share] : edges[r.share + 1]] = np.frombuffer(r.part).reshape(-1, width)
        _add_products(total, bench.passages, bench.idf, bench.unknown, q.astype(np.float32))
        q = np.linalg.svd(total, full_matrices=False)[0]
    return q[:, :rank]


def common_weights(items: np.ndarray, passages: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Of each pair of rows the idf weight of the heaviest common subsequence of words; items are filled up with -2, passages with -1."""
    best = np.zeros((len(passages), passages.shape[1] + 1))
    for word in items.T:
        reached = best[:, :-1] + np.where(passages == word[:, None], idf[word][:, None], -1.0)
        np.maximum.accumulate(np.maximum(best[:, 1:], reached), axis=1, out=best[:, 1:])
    return best[:, -1]


def common_weight(item: np.ndarray, passage: np.ndarray, idf: np.ndarray) -> float:
    """The same of one pair."""
    return float(common_weights(item[None], passage[None], idf)[0])


def _passage_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over each document passage, PASSAGE // STRIDE steps long, from sums over the steps."""
    steps = np.add.reduceat(values, starts, axis=0)
    total = steps.copy()
    for k in range(1, PASSAGE // STRIDE):
        total[:-k or None] += steps[k:]
    return total


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ..., count numbers of each, end to end."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _candidates(ids: np.ndarray, bench: Benchmark) -> Iterator[tuple[int, np.ndarray]]:
    """(step, benchmark passages) of the document passages that hold a leading word and weigh enough."""
    hits = np.flatnonzero(bench.leads[ids])
    if not len(hits):
        return
    size, across = len(bench.leads), PASSAGE // STRIDE
    # a passage is across steps long, so a word lies in the passages that begin at its step and at those before
    pairs = np.unique(((hits // STRIDE)[:, None] - np.arange(across)).ravel() * size + np.repeat(ids[hits], across))
    step, word = np.divmod(pairs[pairs >= 0], size)
    mass = _passage_sums(bench.mass[ids], np.arange(0, len(ids), STRIDE))
    count = bench.leads[word]
    group = np.cumsum(np.bincount(step, count)).astype(np.int64)[step] // TOGETHER
    for one in np.split(np.arange(len(step)), np.flatnonzero(np.diff(group)) + 1):
        passages = bench.led[_spread(bench.led_from[word[one]], count[one])]
        starts = np.repeat(step[one], count[one])
        able = bench.limit[passages] <= mass[starts] + 1e-6
        found = np.unique(starts[able] * len(bench.limit) + passages[able])
        starts, passages = np.divmod(found, len(bench.limit))
        edges = np.flatnonzero(np.diff(starts, prepend=-1))
        for a, z in zip(edges, [*edges[1:], len(starts)], strict=False):
            yield int(starts[a]), passages[a:z]


def _near(ids: np.ndarray, bench: Benchmark) -> Iterator[tuple[int, np.ndarray]]:
    """(step, benchmark passages) of the document passages that are near in the latent space and weigh enough."""
    across, least, each = PASSAGE // STRIDE, bench.weight * NEAR, np.ones((1, STRIDE), np.float32)
    for start in range(0, len(ids), HELD):
        # Passages that begin in this part; the last ones reach into the next.
        part = ids[start : start + HELD + PASSAGE - STRIDE]
        part = np.append(part, np.full(-len(part) % STRIDE, -1, part.dtype))
        starts = np.arange(0, len(part), STRIDE)
        mass = _passage_sums(bench.mass[part], starts)
        able = np.flatnonzero(mass[: HELD // STRIDE] >= least[0])
        if not len(able):
            continue
        steps = [each @ bench.rows.take(part[k : k + SUMMED], axis=0).reshape(-1, STRIDE, bench.rows.shape[1]) for k in range(0, len(part), SUMMED)]
        steps = np.vstack([np.concatenate(steps)[:, 0], np.zeros((across, bench.rows.shape[1]), np.float32)])
        latent = sum(steps[able + k] for k in range(across))
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        cosine = latent @ bench.latent.T
        some = np.flatnonzero(cosine.max(axis=1) >= COSINE)
        at, near = np.nonzero(cosine[some] >= COSINE)
        at = some[at]
        heavy = mass[able[at]] >= least[near]
        at, near = at[heavy], near[heavy]
        edges = np.flatnonzero(np.diff(at, prepend=-1))
        ends = [*edges[1:].tolist(), len(at)]
        for step, a, z in zip((able[at[edges]] + start // STRIDE).tolist(), edges.tolist(), ends, strict=False):
            yield step, near[a:z]


def _leaks_of(found: list[np.ndarray], bench: Benchmark) -> Iterator[tuple]:
    """(place of the document, item, cosine, share, answer) of the leaks in some documents."""
    across = PASSAGE // STRIDE
    # End to end, each filled up to whole steps and so many more that no passage of one reaches into the next.
    steps = np.array([-(-len(x) // STRIDE) for x in found])
    begin = np.cumsum(steps + across - 1) - (steps + across - 1)
    ids = np.full((int(begin[-1] + steps[-1]) + across - 1) * STRIDE, -1, np.int32)
    owner = np.full(len(ids) // STRIDE, -1)
    for n, (x, first, many) in enumerate(zip(found, begin.tolist(), steps.tolist(), strict=True)):
        ids[first * STRIDE : first * STRIDE + len(x)] = x
        owner[first : first + many] = n
    owner = owner.tolist()

    def own(candidates):
        return (one for one in candidates if owner[one[0]] >= 0)

    for step, *leak in _compared(ids, bench, own(_near(ids, bench)), NEAR):
        yield owner[step], *leak
    for step, *leak in _compared(ids, bench, own(_candidates(ids, bench)), SHARE):
        yield owner[step], *leak


def _some(candidates: Iterator[tuple[int, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Candidates of about COMPARED document passages and PAIRS pairs."""
    some, pairs = [], 0
    for one in candidates:
        some.append(one)
        pairs += len(one[1])
        if len(some) >= COMPARED or pairs >= PAIRS:
            yield some
            some, pairs = [], 0
    if some:
        yield some


def _able(ids: np.ndarray, bench: Benchmark, candidates: Iterator[tuple[int, np.ndarray]], least: float) -> Iterator[tuple[int, int, float]]:
    """(step, benchmark passage, answer) of the candidates that have enough words in common."""
    present = np.zeros((COMPARED, len(bench.idf) + 1), np.bool_)  # the last column is that of other words
    line = np.arange(COMPARED)[:, None]
    for some in _some(candidates):
        steps, near = np.array([step for step, _ in some]), np.concatenate([n for _, n in some])
        row = np.repeat(np.arange(len(some)), [len(n) for _, n in some])
        passages = ids[(steps * STRIDE)[:, None] + np.arange(PASSAGE)]
        sizes = bench.size[near]
        words = bench.flat[_spread(bench.begin[near], sizes)]
        present[line[: len(some)], passages] = True
        held = present.ravel().take(np.repeat(row * present.shape[1], sizes) + words)
        present[line[: len(some)], passages] = False
        edges = np.cumsum(sizes) - sizes
        common = np.add.reduceat(bench.mass[words] * held, edges)
        # no common subsequence can weigh more than the words in common
        for at in np.flatnonzero(common >= least * bench.weight[near] - 1e-9).tolist():
            size = sizes[at]
            answer = float(held[edges[at] : edges[at] + size][-max(1, size // 4) :].mean())
            if common[at] >= SURE * bench.weight[near[at]] - 1e-9 or answer >= ANSWER:
                yield steps[row[at]], near[at], answer


def _compared(ids: np.ndarray, bench: Benchmark, candidates: Iterator[tuple[int, np.ndarray]], least: float) -> Iterator[tuple]:
    """(step, item, cosine, share, answer) of the leaks among candidates, of which least of the weight must be found in order where the answer stands as well."""
    able = _able(ids, bench, candidates, least)
    while some := list(islice(able, WEIGHED)):
        steps, near, answer = (np.array(x) for x in zip(*some, strict=True))
        passages = ids[(steps * STRIDE)[:, None] + np.arange(PASSAGE)]
        sizes = bench.size[near]
        items = np.full((len(near), sizes.max()), -2, np.int32)
        items[np.repeat(np.arange(len(near)), sizes), _spread(np.zeros_like(sizes), sizes)] = bench.flat[_spread(bench.begin[near], sizes)]
        share = common_weights(items, passages, bench.idf) / bench.weight[near]
        for at in np.flatnonzero((share >= SURE) | (share >= least) & (answer >= ANSWER)):
            k, latent = near[at], bench.rows[passages[at]].sum(axis=0)
            yield int(steps[at]), bench.item[k], float(latent @ bench.latent[k] / max(np.linalg.norm(latent), 1e-9)), float(share[at]), float(answer[at])


def _block_leaks(docs: DataFrame, bench: Benchmark, rank: int) -> DataFrame:
    numbered = _numbered(docs, bench.vocabulary)
    documents, frequency = _frequencies(numbered, len(bench.vocabulary))
    bench.weigh(documents, frequency)
    bench.project(_basis(numbered, bench, rank))
    bench.vocabulary = {}  # documents are numbers from here on
    sent = docs.sparkSession.sparkContext.broadcast(vars(bench))

    def task(batches):
        import pandas as pd

        bench = Benchmark.of(sent.value)
        for batch in batches:
            found, best = [np.frombuffer(raw, np.int32) for raw in batch["ids"]], {}
            for group in _groups(found):
                for place, item, cosine, share, answer in _leaks_of([found[n] for n in group], bench):
                    pair = group[place], item
                    best[pair] = max(best.get(pair, (0.0, 0.0, 0.0)), (share, cosine, answer))
            keys, doc_ids = batch["key"], batch["doc_id"]
            rows = [(keys.iat[n], doc_ids.iat[n], item, cosine, share, answer) for (n, item), (share, cosine, answer) in best.items()]
            yield pd.DataFrame(rows, columns=["key", "doc_id", "item_id", "cosine", "common", "answer"])

    return numbered.mapInPandas(task, "key string, doc_id long, item_id long, cosine double, common double, answer double")


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK, items: int = ITEMS) -> DataFrame:
    """(key, doc_id, item_id, cosine, common, answer): every document with every benchmark item it holds."""
    docs = df.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    blocks = max(1, -(-asked.count() // items))
    out = None
    for k in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text").collect()
        bench = Benchmark([tuple(r) for r in rows])
        if bench.passages:
            found = _block_leaks(docs, bench, rank)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.filter("false").select("key", "doc_id", F.lit(0).cast("long").alias("item_id"), *(F.lit(0.0).alias(c) for c in ("cosine", "common", "answer")))
    return out.dropDuplicates(["key", "doc_id", "item_id"])


def without_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that hold no benchmark item."""
    leaks = find_leaks(df, benchmark, id_col, text_col).select("key").distinct()
    rows = df.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key")).join(leaks, "key", "left_anti")
    return rows.select(*(F.col("row").getField(c).alias(c) for c in df.columns))


def decontam_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of the benchmark in all documents."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    found = find_leaks(docs, benchmark)
    return found.select("doc_id", "item_id", *(F.round(c, 4).alias(c) for c in ("cosine", "common", "answer")))
