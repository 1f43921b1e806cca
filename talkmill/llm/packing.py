"""Best-fit packing of documents into sequences of at most CAPACITY tokens.

A document is its token ids and an end id. One longer than a sequence is cut into pieces of CAPACITY tokens,
the first of which may be shorter; shorter documents stay whole.

Packing needs sizes alone, and there are at most CAPACITY different ones. The driver gets the number of pieces of
each size and plans over these numbers: pieces above a third of the capacity are matched greedily, the largest
first, each with the largest partner that still fits, so a sequence holds at most two of them. Smaller ones, the largest
first, go to the sequence with the smallest gap that takes them. Equal sizes are placed together: a plan is a list of runs, each of
which says that so many pieces of one size go to consecutive sequences at the same offsets. A step splits
at most one class of like sequences, which bounds classes to a few times CAPACITY; the distinct sizes in
a sequence add up to at most CAPACITY, which bounds runs to about sqrt(2 x CAPACITY) times that, whatever the number of documents.

A piece finds its run by its number among those of its size: its number in its task, written with it, plus the
pieces of that size in tasks before, summed from one row for each task and size. So a size that a third of all
pieces have is never gathered, and a lost executor changes no number.

Null texts count as empty and are the end id alone; rows that repeat are packed each; an empty table gives no
rows; only the id and text columns are read.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from talkmill.llm.components import written
from talkmill.llm.pieces import byte_letters, byte_widths, parts
from talkmill.llm.rows import narrow

CAPACITY = 2048
END = 0
#: Words kept with their ids in a task; beyond it the cache is emptied.
CACHED = 600_000
#: Visible ASCII, Latin letters and line ends, classed alike by every version of Unicode.
_LATIN = re.compile("[\n -~À-ɏ]+")
#: Words that are empty or have white space at an end, among words joined by blanks.
_UNEVEN = re.compile(" \\s|\\s |\\s\\Z")
#: New words encoded in one call.
JOINED = 4000


def merge_ranks(definition: str) -> dict[bytes, int] | None:
    """The entries of a byte-level BPE by rank, if merging by rank gives the ids that its list of merges gives.

    It does if ids follow the order of merges and every entry's own bytes merge to that entry. For assume that two
    neighbours make up an entry but are not the two its merge names: no merge has reached over their outer ends, so
    the entry's bytes alone would have come to the same two neighbours, and could not merge to the entry.
    """
    model = json.loads(definition)["model"]
    letters = byte_letters()
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    numbers = [model["vocab"][a + b] for a, b in pairs]
    if model["type"] != "BPE" or any(x >= y for x, y in zip(numbers, numbers[1:], strict=False)) or len(numbers) + len(letters) != len(model["vocab"]):
        return None
    order = {pair: n for n, pair in enumerate(pairs)}
    for a, b in pairs:
        own = list(a + b)
        while len(own) > 1:
            least, at = min((order.get(pair, len(order)), k) for k, pair in enumerate(zip(own, own[1:], strict=False)))
            if least == len(order):
                return None
            own[at : at + 2] = [own[at] + own[at + 1]]
    ranks = {bytes(letters[c] for c in entry): number for entry, number in model["vocab"].items()}
    return ranks if min(numbers) > max(ranks[bytes([b])] for b in range(256)) else None


class Encoder:
    """Token ids of whole texts, each distinct word behind a blank encoded once.

    A blank before a character that is not white space opens a word of the tokenizer's pattern, so what follows it does not
    depend on what came before. Texts with a blank before other white space or at their end are encoded whole.

    With ranks (see merge_ranks), words of ASCII and Latin letters are merged by tiktoken, several times as fast and to the
    same ids; all others go through the tokenizer itself.
    """

    def __init__(self, definition: str, ranks: dict[bytes, int] | None = None, pattern: str = ""):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.width = byte_widths(self.tokenizer)
        self.ranked = None
        if ranks:
            import tiktoken

            self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        #: Numbers of words behind a blank, and of those that open a text, which have a blank in front here.
        self.number: dict[str, int] = {}
        self.uneven: set[str] = set()
        #: All known words' ids behind each other, and where each word's begin.
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Words joined behind each other are encoded in one call and told apart by the bytes of their tokens."""
        kept, ids, sizes = [], [self.ids], [np.diff(self.starts)]
        alone = [w for w in new if w[:1] == " "]
        new = [w for w in new if w[:1] != " "]
        for start in range(0, len(new), JOINED):
            words = new[start : start + JOINED]
            text = " " + " ".join(words)
            if _UNEVEN.search(text):
                odd = [w for w in words if not w or w[0].isspace() or w[-1].isspace()]
                self.uneven.update(w for w in odd if not w or w[0].isspace())
                alone += [w for w in odd if w and not w[0].isspace()]
                words = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
                text = " " + " ".join(words)
            if words:
                found = self._ids(text)
                raw = np.frombuffer(text.encode(), np.uint8)
                edges = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
                ends = np.searchsorted(np.cumsum(self.width[found]), edges) + 1
                kept += words
                ids.append(found)
                sizes.append(np.diff(ends, prepend=0))
        own = self.whole([w[1:] if w[0] == " " else " " + w for w in alone])
        ids += own
        sizes.append(np.array([len(x) for x in own], np.int64))
        first = len(sizes[0])
        self.number.update(zip([*kept, *alone], range(first, first + len(kept) + len(alone)), strict=True))
        self.ids, self.starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _ids(self, text: str) -> np.ndarray:
        if self.ranked and _LATIN.fullmatch(text) and "<|" not in text:
            return self.ranked.encode_to_numpy(text, disallowed_special=())
        return self.whole([text])[0]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.number) > CACHED:
            self._clear()
        number, rows = self.number, []
        for n, text in enumerate(texts):
            for part in parts(text):
                words = part.split(" ")
                words[0] = " " + words[0]
                rows.append((n, words))
        self.learn(list(set().union(*(words for _, words in rows)).difference(number, self.uneven)))
        odd = {n for n, words in rows if words[0][-1:].isspace() and len(words[0]) > 1 or not self.uneven.isdisjoint(words)}
        even = [(n, words) for n, words in rows if n not in odd]
        sizes = [len(words) for _, words in even]
        found = np.fromiter(map(number.__getitem__, chain.from_iterable(words for _, words in even)), np.int64, sum(sizes))
        many = np.diff(self.starts)[found]
        before = np.cumsum(many) - many
        ids = self.ids[np.arange(many.sum()) + np.repeat(self.starts[found] - before, many)]
        text_of = np.repeat(np.fromiter((n for n, _ in even), np.int64, len(even)), sizes)
        edges = np.searchsorted(np.repeat(text_of, many), np.arange(len(texts) + 1))
        out = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for n, own in zip(sorted(odd), self.whole([texts[n] for n in sorted(odd)]), strict=True):
            out[n] = own
        return out


def cut_document(size: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of so many tokens; only the first may be shorter."""
    start, length = 0, size % capacity or min(size, capacity)
    while start < size:
        yield start, length
        start, length = start + length, capacity


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (size, first, pieces, sequence, times, offset) for so many pieces of each size.

    Pieces number first, first + 1, ... of that size go, times each, to sequence, sequence + 1, ..., one behind the
    other from offset on.
    """
    # A class is [number of sequences, contents], the contents a chain (size, times, rest of the contents).
    large = sorted(s for s in counts if 3 * s > capacity and counts[s])
    left = {s: counts[s] for s in large}
    classes: list[tuple[int, int, tuple]] = []  # (gap, sequences, contents)
    while large:
        top = large[-1]
        own = left[top]
        at = bisect_left(large, capacity - top + 1) - 1
        if at < 0:
            classes.append((capacity - top, own, (top, 1, None)))
            large.pop()
            continue
        partner = large[at]
        if partner == top:
            if own // 2:
                classes.append((capacity - 2 * top, own // 2, (top, 2, None)))
            left[top] = own % 2
            if not left[top]:
                large.pop()
            elif at:
                # The odd one takes the next smaller partner.
                partner = large[at - 1]
                classes.append((capacity - top - partner, 1, (partner, 1, (top, 1, None))))
                left[partner] -= 1
                large.pop()
                if not left[partner]:
                    large.remove(partner)
            else:
                classes.append((capacity - top, 1, (top, 1, None)))
                large.pop()
            continue
        pairs = min(own, left[partner])
        classes.append((capacity - top - partner, pairs, (partner, 1, (top, 1, None))))
        for size in (top, partner):
            left[size] -= pairs
            if not left[size]:
                large.remove(size)
    gaps: dict[int, list[list]] = {}
    for gap, number, held in classes:
        gaps.setdefault(gap, []).append([number, held])
    order = sorted(gaps)
    for size in sorted((s for s in counts if 3 * s <= capacity and counts[s]), reverse=True):
        rest = counts[size]
        while rest:
            at = bisect_left(order, size)
            if at == len(order):
                times = capacity // size
                number, few = divmod(rest, times)
                for amount, fill in ((number, times), (1, few)):
                    if amount and fill:
                        _add(gaps, order, capacity - fill * size, [amount, (size, fill, None)])
                break
            gap = order[at]
            times = gap // size
            bins = gaps[gap]
            number, held = bins.pop()
            if not bins:
                del gaps[gap], order[at]
            full = min(number, rest // times)
            if full:
                _add(gaps, order, gap - times * size, [full, (size, times, held)])
            number, rest = number - full, rest - full * times
            if number and rest:
                _add(gaps, order, gap - rest * size, [1, (size, rest, held)])
                number, rest = number - 1, 0
            if number:
                _add(gaps, order, gap, [number, held])
    runs, first, sequence = [], dict.fromkeys(counts, 0), 0
    for gap in order:
        for number, held in gaps[gap]:
            offset = 0
            while held:
                size, times, held = held
                runs.append((size, first[size], number * times, sequence, times, offset))
                first[size] += number * times
                offset += times * size
            sequence += number
    return runs


def _add(gaps: dict, order: list, gap: int, entry: list) -> None:
    if gap not in gaps:
        gaps[gap] = []
        insort(order, gap)
    gaps[gap].append(entry)


def pieces_of(docs: DataFrame, definition: str, pattern: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): the pieces of (doc_id, text), numbered by size in their task."""
    shared = docs.sparkSession.sparkContext.broadcast((definition, merge_ranks(definition) if pattern else None, pattern))
    tail = end.to_bytes(4, "little")

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        number = TaskContext.get().partitionId()
        encoder, seen = Encoder(*shared.value), {}
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for some in _some(texts):
                rows = []
                for doc_id, own in zip(ids[some], encoder(texts[some]), strict=True):
                    raw = memoryview(own.astype("<u4").tobytes() + tail)
                    for piece, (start, length) in enumerate(cut_document(len(raw) // 4, capacity)):
                        nth = seen[length] = seen.get(length, -1) + 1
                        rows.append((doc_id, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), number, nth))
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds, strict=True)], names)

    return docs.mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def _some(texts: list[str], most: int = 2_000_000) -> Iterator[slice]:
    """Consecutive runs of texts of about so many characters."""
    start = size = 0
    for n, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield slice(start, n + 1)
            start, size = n + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items of pieces_of, a written table, with sequence_id and offset in place of task and nth."""
    by_task = items.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    runs = sorted(plan(counts, capacity))
    # One number orders runs by size and first piece; 2**40 pieces of a size are far beyond any table.
    table = np.array(runs, np.int64).reshape(-1, 6)
    shared = items.sparkSession.sparkContext.broadcast(table)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def task(batches):
        import pyarrow as pa

        size, first, _, sequence, times, offset = shared.value.T
        key = (size << 40) + first
        for batch in batches:
            own, rank = (batch.column(name).to_numpy() for name in ("length", "nth"))
            at = np.searchsorted(key, (own << 40) + rank, side="right") - 1
            inside = rank - first[at]
            places = [pa.array(sequence[at] + inside // times[at]), pa.array(offset[at] + inside % times[at] * own)]
            yield pa.RecordBatch.from_arrays(batch.columns[:5] + places, [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = items.join(before, ["length", "task"]).withColumn("nth", F.col("nth") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "nth").mapInArrow(task, schema)


def pack(
    df: DataFrame,
    definition_path: str,
    pattern: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    definition_path, a tokenizer's file, is read by the driver and broadcast. pattern is the expression by which the tokenizer
    cuts words, if it is known; it allows the faster way (see Encoder).
    """
    with open(definition_path, encoding="utf-8") as file:
        definition = file.read()
    return place(written(pieces_of(narrow(df, id_col, text_col), definition, pattern, capacity, end), "packing"), capacity)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
