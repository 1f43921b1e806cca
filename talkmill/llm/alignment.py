"""Alignment of two tokenizers over the bytes of each text.

Side A is a byte-level BPE file of the tokenizers library, side B a sentencepiece model with byte fallback, which
itself puts a blank in front; A is given that blank. A's character offsets and the byte spans of sentencepiece (its
offset mapping, which took the place of the immutable proto) are coarse cuts: the end of a token counts as known
where its span is as long as its decoded bytes. Where it is not, within a character of several bytes, at byte-fallback tokens and
at the blank put in front, the end follows from the last known one and the decoded bytes between. Byte offsets
at which a token of A and one of B end cut both into groups; every token of A in a group is linked to every one of B.

Texts are cut at borders that no token of either side crosses (``pieces``), so a task encodes
each distinct piece once, many in one call, and adds up groups and links of the pieces of a text. A text that is null or
empty, or whose tokens' bytes are not the text's, has no tokens.

How many documents hold a pair of ids linked is counted over all documents: tasks add up what their documents hold before
pairs are shuffled. The pairs in most documents, at most HEAVY, are then broadcast, and resolve most links of a
document where it lies; the others are joined by pair. Neither way drops any.

Rows that repeat count as a document each; an empty table gives no rows; only id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from talkmill.llm.components import written
from talkmill.llm.pieces import batched, byte_entries, cut, cut_word, fine_for, parts, safe_for
from talkmill.llm.rows import narrow

HEAVY = 400_000
#: Pieces kept with their groups in a task; beyond it the cache is emptied.
CACHED = 400_000
#: Texts, or parts of long ones, of so many characters are added up together.
TOGETHER = 1_000_000
#: Distinct pairs a task holds while it counts documents.
COUNTED = 2_000_000


def _gathered(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights[order], first)


def _each(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] numbers, then the same from starts[1] on, and so on."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


def _spans(offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(offsets), np.int64, 2 * len(offsets)).reshape(-1, 2)


_NONE = np.empty(0, np.int64)
#: What a piece has whose bytes its tokens do not give.
_UNFIT = [""], np.zeros((1, 5), np.int64), _NONE, _NONE, np.zeros(1, np.int64)
_UNFIT_PAIR = ["", ""], np.zeros((2, 5), np.int64), _NONE, _NONE, np.zeros(2, np.int64)
_GUARD = " a"


class Side:
    """One tokenizer: ids and byte ends of the tokens of texts that begin with a blank."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.size = len(raw)
        self.shown = list(map(str, range(len(raw))))
        self.width = np.array([len(r) for r in raw], np.int64)

    def ends(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Coarse spans refined by decoded bytes."""
        own = self.width[ids]
        total = np.cumsum(own)
        known = np.maximum.accumulate(np.where(ends - starts == own, np.arange(len(ids)), -1))
        return np.where(known >= 0, ends[known] + total - total[known], total)

    def fits(self, ids: np.ndarray, text: bytes) -> bool:
        return b"".join([self.raw[i] for i in ids.tolist()]) == text


class ByteLevel(Side):
    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        super().__init__(byte_entries(self.tokenizer))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ids, spans = np.array(found.ids, np.int64), _spans(found.offsets)
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            spans = np.concatenate([[0], np.cumsum(widths)])[spans]
        return ids, self.ends(ids, spans[:, 0], spans[:, 1])


class Pieces(Side):
    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        entries = [self.model.id_to_piece(n) for n in range(self.model.get_piece_size())]
        super().__init__([bytes([int(e[3:5], 16)]) if self.model.is_byte(n) else e.replace("▁", " ").encode() for n, e in enumerate(entries)])
        self.safe, self.fine = safe_for(entries), safe_for(entries) and fine_for(entries)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(text[1:], return_type="offset_mapping", return_bytes=True)
        ids, spans = np.array(found["ids"], np.int64), _spans(found["offsets"]) + 1
        return ids, self.ends(ids, spans[:, 0], spans[:, 1])


class Aligner:
    """Groups and links of texts, by those of their distinct pieces."""

    def __init__(self, definition: str, model: bytes):
        self.a, self.b = ByteLevel(definition), Pieces(model)
        self._clear()

    def _clear(self) -> None:
        #: Numbers of pieces, and of words (the blank in front left out) with the numbers of their pieces.
        self.number: dict[str, int] = {}
        self.word: dict[str, int] = {}
        self.members, self.member_counts = np.empty(0, np.int32), np.empty(0, np.int32)
        self.uneven: set[str] = set()
        self.shown: list[str] = []
        #: tokens of A, tokens of B, groups, links, and whether the bytes fit, for each piece.
        self.stats = np.empty((0, 5), np.int32)
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int32)
        self.counts = np.empty(0, np.int32)

    def learn(self, words: list[str]) -> None:
        """New words, the blank in front left out."""
        split = [cut_word(" " + word) if self.b.fine else [" " + word] for word in words]
        new = list(set(chain.from_iterable(split)).difference(self.number))
        stats, pairs, times, counts = [self.stats], [self.pairs], [self.times], [self.counts]

        def keep(pieces: list[str], found: tuple | None, step: int = 1) -> None:
            shown, *arrays = found or _UNFIT
            self.number.update(zip(pieces[step - 1 :: step], range(len(self.shown) + step - 1, len(self.shown) + len(pieces), step), strict=True))
            self.shown += shown
            for kept, part in zip((stats, pairs, times, counts), arrays, strict=True):
                kept.append(part.astype(kept[0].dtype))

        for pieces in batched([piece for piece in new if piece[0] == " "]):
            joined = self._aligned(pieces)
            for some, found in [(pieces, joined)] if joined else [([piece], self._aligned([piece])) for piece in pieces]:
                keep(some, found)
        # Pieces without a blank in front stand behind a word of their own.
        inner = [piece for piece in new if piece[0] != " "]
        for start in range(0, len(inner), 2000):
            pieces = [x for piece in inner[start : start + 2000] for x in (_GUARD, piece)]
            joined = self._aligned(pieces)
            pairs_of = [(pieces, joined)] if joined else [([_GUARD, piece], self._aligned([_GUARD, piece])) for piece in pieces[1::2]]
            for some, found in pairs_of:
                keep(some, found or _UNFIT_PAIR, 2)
        self.stats, self.pairs, self.times, self.counts = map(np.concatenate, (stats, pairs, times, counts))
        many = np.fromiter(map(len, split), np.int32, len(split))
        members = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int32, int(many.sum()))
        self.word.update(zip(words, range(len(self.member_counts), len(self.member_counts) + len(words)), strict=True))
        self.members, self.member_counts = np.concatenate([self.members, members]), np.concatenate([self.member_counts, many])

    def _aligned(self, pieces: list[str]):
        """What each piece has, from the tokens of all joined; None if the tokens' bytes are not the text's."""
        text = "".join(pieces)
        raw = text.encode()
        (a, a_ends), (b, b_ends) = self.a(text), self.b(text)
        if not (self.a.fits(a, raw) and self.b.fits(b, raw)):
            return None
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        edges = np.cumsum([len(p.encode()) for p in pieces])
        if not np.isin(edges, cuts).all():
            return None
        group_a, group_b = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        piece = np.searchsorted(edges, cuts)
        many = len(pieces)
        # Distinct ids of each group, so a group of many tokens does not become as many pairs.
        ids_a, n_a = _gathered(group_a * self.a.size + a, np.ones(len(a), np.int64))
        ids_b, n_b = _gathered(group_b * self.b.size + b, np.ones(len(b), np.int64))
        first_b = np.searchsorted(ids_b, np.arange(len(cuts) + 1) * self.b.size)
        group = ids_a // self.a.size
        partners = first_b[group + 1] - first_b[group]
        at_a, at_b = np.repeat(np.arange(len(ids_a)), partners), _each(first_b[group], partners)
        pair = ids_a[at_a] % self.a.size * self.b.size + ids_b[at_b] % self.b.size
        times = n_a[at_a] * n_b[at_b]
        space = self.a.size * self.b.size
        if many * space < 1 << 62:
            held, times = _gathered(piece[group[at_a]] * space + pair, times)
            holder, pair = held // space, held % space
        else:
            holder = piece[group[at_a]]
        count_a, count_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        stats = np.ones((many, 5), np.int64)
        for column, weight in enumerate((count_a, count_b, np.ones(len(cuts), np.int64), count_a * count_b)):
            total = np.concatenate([[0], np.cumsum(weight)])
            bounds = np.searchsorted(piece, np.arange(many + 1))
            stats[:, column] = total[bounds[1:]] - total[bounds[:-1]]
        left, right = [self.a.shown[i] for i in a.tolist()], [self.b.shown[i] for i in b.tolist()]
        to_a, to_b = np.cumsum(count_a).tolist(), np.cumsum(count_b).tolist()
        shown = [
            left[i] + "|" + right[k] if i + 1 == j and k + 1 == m else ",".join(left[i:j]) + "|" + ",".join(right[k:m])
            for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False)
        ]
        bounds = bounds.tolist()
        return (
            [";".join(shown[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)],
            stats,
            pair,
            times,
            np.bincount(holder, minlength=many),
        )

    def cut(self, texts: list[str]) -> list[list[str]]:
        """Words of texts that begin with a blank, the blank in front of each left out; all are known afterwards.

        Where no blank is beside other white space, words are what stands between blanks.
        """
        if not self.b.safe:
            split, odd = [[text[1:]] for text in texts], []
            self.learn(list(set().union(*split).difference(self.word)))
            return split
        split = [text.split(" ")[1:] for text in texts]
        new = set().union(*split).difference(self.word, self.uneven)
        self.uneven.update(word for word in new if not word or word[0].isspace() or "▁" in word)
        self.learn(list(new - self.uneven))
        odd = [n for n, words in enumerate(split) if not self.uneven.isdisjoint(words)]
        for n in odd:
            split[n] = [piece[1:] for piece in cut(texts[n])]
        self.learn(list(set().union(*(split[n] for n in odd)).difference(self.word)))
        return split

    def block(self, some: list[tuple[int, str]]) -> dict[int, tuple]:
        """document → (stats, shown groups of its pieces, pairs, times) for (document, part) in order of documents."""
        if len(self.number) > CACHED:
            self._clear()
        split = self.cut([part for _, part in some])
        lengths = [len(words) for words in split]
        words = np.fromiter(map(self.word.__getitem__, chain.from_iterable(split)), np.int64, sum(lengths))
        many = self.member_counts[words]
        numbers = self.members[_each((np.cumsum(self.member_counts) - self.member_counts)[words], many)].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(many)])[np.cumsum(lengths)]
        sizes = np.diff(ends, prepend=0)
        documents = sorted({n for n, _ in some})
        place = {n: k for k, n in enumerate(documents)}
        doc = np.repeat([place[n] for n, _ in some], sizes)
        bounds = np.searchsorted(doc, np.arange(len(documents) + 1))
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.stats[numbers], axis=0, dtype=np.int64)])
        stats = sums[bounds[1:]] - sums[bounds[:-1]]
        stats[:, 4] = stats[:, 4] == np.diff(bounds)
        size = max(1, len(self.shown))
        each, often = _gathered(doc * size + numbers, np.ones(len(doc), np.int64))
        own, number = each // size, each % size
        first = np.cumsum(self.counts, dtype=np.int64) - self.counts
        held = self.counts[number]
        at = _each(first[number], held)
        space = self.a.size * self.b.size
        keys, times = _gathered(np.repeat(own, held) * space + self.pairs[at], np.repeat(often, held) * self.times[at].astype(np.int64))
        pair_bounds = np.searchsorted(keys, np.arange(len(documents) + 1) * space)
        out = {}
        for k, n in enumerate(documents):
            some_pairs = slice(pair_bounds[k], pair_bounds[k + 1])
            shown = ";".join(map(self.shown.__getitem__, numbers[bounds[k] : bounds[k + 1]].tolist()))
            out[n] = stats[k], shown, keys[some_pairs] % space, times[some_pairs]
        return out

    def whole(self, text: str) -> tuple | None:
        """A text that its pieces don't fit, as one piece."""
        found = self._aligned([text])
        return found and (found[1][0], found[0][0], found[2], found[3])

    def documents(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """(tokens of A, of B, groups and links; digest of the groups; pairs; times) of each text."""
        nothing = np.zeros(4, np.int64), "", _NONE, _NONE
        held: dict[int, list] = {}
        done = 0

        def closed(limit: int) -> Iterator[tuple]:
            nonlocal done
            for n in range(done, limit):
                results = held.pop(n, [])
                if results and not all(stats[4] for stats, *_ in results):
                    one = self.whole(" " + texts[n])
                    results = [one] if one else []
                if not results:
                    yield nothing
                    continue
                pairs, times = _gathered(*(np.concatenate(x) for x in list(zip(*results, strict=True))[2:]))
                digest = hashlib.sha256(";".join(shown for _, shown, _, _ in results).encode()).hexdigest()
                yield sum(stats for stats, *_ in results)[:4], digest, pairs, times
            done = limit

        some, size = [], 0
        for n, text in enumerate(texts):
            for part in parts(" " + text, TOGETHER) if text else ():
                some.append((n, part))
                size += len(part)
                if size >= TOGETHER:
                    for k, result in self.block(some).items():
                        held.setdefault(k, []).append(result)
                    some, size = [], 0
                    yield from closed(n)
        if some:
            for k, result in self.block(some).items():
                held.setdefault(k, []).append(result)
        yield from closed(len(texts))


def align(docs: DataFrame, definition: str, model: bytes) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of (doc_id, text).

    row numbers the rows; pairs (a * size of B + b) and times are arrays of little-endian unsigned 32-bit (pairs: 64-bit)
    integers.
    """
    shared = docs.sparkSession.sparkContext.broadcast((definition, model))

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        aligner, row = Aligner(*shared.value), TaskContext.get().partitionId() << 36
        names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        for batch in _slices(batches):
            stats, digests, pairs, times = zip(*((s, d, p.astype("<u8").tobytes(), t.astype("<u4").tobytes()) for s, d, p, t in aligner.documents(batch.column("text").to_pylist())), strict=True)
            stats = np.array(stats).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(stats))), batch.column("doc_id"), *(pa.array(stats[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())],
                names,
            )
            row += len(stats)

    return docs.mapInArrow(task, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def _slices(batches, rows: int = 500):
    """Batches of few rows, as what a row becomes is larger than the row."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _joined(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of arrays, and the number of the row of each."""
    raw = column.to_pylist()
    sizes = np.array([len(r) for r in raw], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(raw), kind).astype(np.int64), np.repeat(np.arange(len(raw)), sizes)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, docs, best): in how many documents each pair is linked, and whether no pair of its id of A is in more."""

    def task(batches):
        import pyarrow as pa

        keys, docs = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in _slices(batches):
            new, _ = _joined(batch.column("pairs"), "<u8")
            keys, docs = _gathered(np.concatenate([keys, new]), np.concatenate([docs, np.ones(len(new), np.int64)]))
            if len(keys) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs)], ["pair", "docs"])
                keys, docs = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs)], ["pair", "docs"])

    counts = aligned.select("pairs").mapInArrow(task, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    # An id of A has at most as many pairs as B has ids.
    most = F.max("docs").over(Window.partitionBy(F.expr(f"pair div {b_size}")))
    return counts.withColumn("best", F.col("docs") == most)


def _heavy(counts: DataFrame, most: int) -> tuple[int, np.ndarray]:
    """(least number of documents, (pair, docs, best) of all pairs in that many): at most so many rows."""
    level = F.floor(F.log2("docs")).cast("int")
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, max(sizes, default=0) + 1
    while least > 0 and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    rows = counts.filter(level >= least).select("pair", "docs", F.col("best").cast("long")).toArrow()
    table = np.stack([rows.column(k).to_numpy() for k in range(3)])
    return least, table[:, np.argsort(table[0])]


def resolve(aligned: DataFrame, counts: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), all links of a document looked up in counts."""
    least, table = _heavy(counts, heavy)
    shared = aligned.sparkSession.sparkContext.broadcast(table)

    def task(batches):
        import pyarrow as pa

        pairs, docs, best = shared.value
        for batch in _slices(batches):
            keys, row = _joined(batch.column("pairs"), "<u8")
            times, _ = _joined(batch.column("times"), "<u4")
            at = np.searchsorted(pairs, keys)
            found = np.zeros(len(keys), bool)
            if len(pairs):
                at[at == len(pairs)] = 0
                found = pairs[at] == keys
            sums = []
            for value in (best, docs):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, row[found], value[at[found]] * times[found])
                sums.append(pa.array(total))
            rest = [[], []]
            kept, kept_row, kept_times = keys[~found], row[~found], times[~found]
            bounds = np.searchsorted(kept_row, np.arange(batch.num_rows + 1)).tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                rest[0].append(kept[a:b].tolist() if b > a else None)
                rest[1].append(kept_times[a:b].tolist() if b > a else None)
            arrays = [pa.array(r, pa.list_(pa.int64())) for r in rest]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *sums, *arrays], [*batch.schema.names[:7], "n_best", "count_sum", "rest", "rest_times"])

    first = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    known = aligned.mapInArrow(task, first + ", n_best long, count_sum long, rest array<long>, rest_times array<long>")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least <= 0:
        return known.select(*out)
    known = written(known, "alignment-known")
    rest = known.filter("rest is not null").select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("e"))
    rest = rest.select("row", F.col("e.rest").alias("pair"), F.col("e.rest_times").alias("often"))
    more = (
        rest.join(counts, "pair")
        .groupBy("row")
        .agg(F.sum(F.expr("if(best, often, 0)")).alias("more_best"), F.sum(F.expr("often * docs")).alias("more_sum"))
    )
    both = known.join(more, "row", "left")
    return both.withColumns({"n_best": F.expr("n_best + coalesce(more_best, 0)"), "count_sum": F.expr("count_sum + coalesce(more_sum, 0)")}).select(*out)


def cross_align(df: DataFrame, a_path: str, b_path: str, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of df.

    Both files, fixed vocabularies, are read by the driver and broadcast.
    """
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        definition, model = a.read(), b.read()
    aligned = written(align(narrow(df, id_col, text_col), definition, model), "alignment")
    counts = written(pair_counts(aligned, Pieces(model).size), "alignment-pairs")
    return resolve(aligned, counts, heavy)


def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document, with the corpus-wide counts of its pairs."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cross_align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
