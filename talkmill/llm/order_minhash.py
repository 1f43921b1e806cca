"""Document fingerprints by Order MinHash: which k-mers are least, and in which order the text has them.

A k-mer of code points is numbered by its occurrence in the text, so repeats count apart. For each of SKETCHES
hash functions the TUPLE least (k-mer, occurrence) pairs are taken, put back into text order and hashed as a
tuple. Likeness of two fingerprints is the share of equal tuples: moving a passage changes order, as
edit distance does, where plain MinHash would see no change. Texts shorter than a k-mer are one k-mer; an empty
text has a fingerprint of its own. Equal texts have equal fingerprints.

Documents are ordered by (id, text hash), null ids first. Only one shuffle moves texts, compressed, into
ranges of that order; a task streams its range and meets each text's next one there. The ends of ranges,
two texts for each, are written with the rest and joined afterwards. Null texts count as empty; rows that repeat are
neighbours; an only document is its own next; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from talkmill.llm.components import written

KMER = 6
SKETCHES = 32
TUPLE = 2
#: K-mers hashed together; longer texts go on in steps.
STEP = 1 << 16

_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = _mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * _M)
    return (numbers[:count] >> np.uint64(32)).astype(np.uint32), (numbers[count:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class OrderMinHash:
    def __init__(self, kmer: int = KMER, sketches: int = SKETCHES, size: int = TUPLE):
        self.kmer, self.sketches, self.size = kmer, sketches, size
        add, times = _seeds(sketches)
        self.add, self.times = add[:, None], times[:, None]

    def numbered(self, text: str) -> np.ndarray:
        """A hash of every k-mer with its occurrence number, in text order."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if not len(points):
            return np.empty(0, np.uint64)
        size = min(self.kmer, len(points))
        count = len(points) - size + 1
        x = np.full(count, size, np.uint64)
        for k in range(size):
            x = x * _M + points[k : k + count]
        x = _mixed(x)
        bits = np.uint64(max(1, (count - 1).bit_length()))
        place = np.arange(count, dtype=np.uint64)
        by = np.sort((x >> bits << bits) | place)  # hash, then place
        spot = (by & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.intp)
        new = np.flatnonzero(np.r_[True, (by[1:] >> bits) != (by[:-1] >> bits)])
        nth = np.arange(count) - np.repeat(new, np.diff(np.r_[new, count]))
        number = np.empty(count, np.uint64)
        number[spot] = nth
        return _mixed(x + number * np.uint64(0xD6E8FEB86659FD93))

    def __call__(self, text: str) -> np.ndarray:
        """One 32-bit hash for each hash function."""
        ids = self.numbered(text)
        rank, place = np.empty((self.sketches, 0), np.uint32), np.empty((self.sketches, 0), np.int64)
        for start in range(0, len(ids), STEP):
            short = (ids[start : start + STEP] >> np.uint64(32)).astype(np.uint32)
            value = (short[None, :] ^ self.add) * self.times
            value ^= value >> np.uint32(15)
            for _ in range(min(self.size, len(short))):
                least = value.argmin(axis=1)[:, None]
                rank = np.concatenate([rank, np.take_along_axis(value, least, 1)], axis=1)
                place = np.concatenate([place, least + start], axis=1)
                np.put_along_axis(value, least, np.uint32(0xFFFFFFFF), 1)
        chosen = np.lexsort((place, rank), axis=1)[:, : self.size]
        ordered = np.sort(np.take_along_axis(place, chosen, 1), axis=1)
        out = np.full(self.sketches, ordered.shape[1] + 1, np.uint64)
        for k in range(ordered.shape[1]):
            out = _mixed(out * _M + ids[ordered[:, k]])
        return (out >> np.uint64(32)).astype("<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the following text's start, or all of it."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _row(sketch: OrderMinHash, doc_id, text: str, own: np.ndarray, next_text: str, next_own: np.ndarray) -> tuple:
    changed = edited(text, next_text)
    other = sketch(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), own.tobytes(), other.tobytes(), likeness(own, other), likeness(own, next_own), None, None, None)


_COLUMNS = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "hash", "packed", "last"]
_SCHEMA = "doc_id long, n_chars long, edited binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, hash long, packed binary, last boolean"


def _packed(docs: DataFrame) -> DataFrame:
    def task(batches):
        for batch in batches:
            yield batch.assign(packed=[zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in batch["text"]])[["doc_id", "hash", "packed"]]

    return docs.mapInPandas(task, "doc_id long, hash long, packed binary")


def _text(packed: bytes) -> str:
    return zlib.decompress(packed).decode("utf-8", "surrogatepass")


def _ranges(ordered: DataFrame) -> DataFrame:
    """Rows of all but the last document of each range, and the two ends of each range with their texts."""

    def task(batches):
        import pandas as pd

        sketch, held, first = OrderMinHash(), None, True
        end = lambda doc_id, mark, packed, last: (doc_id, None, None, None, None, None, None, mark, packed, last)
        for batch in batches:
            rows = []
            numbers = batch["doc_id"].astype("object").where(batch["doc_id"].notna(), None)
            for doc_id, mark, packed in zip(numbers, batch["hash"], batch["packed"], strict=True):
                text = _text(packed)
                own = sketch(text)
                if first:
                    rows.append(end(doc_id, mark, packed, False))
                    first = False
                if held:
                    rows.append(_row(sketch, held[0], held[3], held[4], text, own))
                held = (doc_id, mark, packed, text, own)
            yield pd.DataFrame(rows, columns=_COLUMNS)
        if held:
            yield pd.DataFrame([end(*held[:3], True)], columns=_COLUMNS)

    return ordered.mapInPandas(task, _SCHEMA)


def _joined_ends(ends: DataFrame) -> DataFrame:
    """Rows of each range's last document: its next is the first of the next range, of the first range at the end."""
    turn = F.row_number().over(Window.orderBy("doc_id", "hash"))  # over two rows for each range
    starts, stops = ends.filter("not last"), ends.filter("last").withColumn("turn", turn)
    count = starts.count()
    starts = starts.select(F.col("packed").alias("next_packed"), turn.alias("at"))
    starts = starts.withColumn("turn", F.when(F.col("at") == 1, count).otherwise(F.col("at") - 1))

    def task(batches):
        import pandas as pd

        sketch = OrderMinHash()
        for batch in batches:
            numbers = batch["doc_id"].astype("object").where(batch["doc_id"].notna(), None)
            rows = []
            for doc_id, packed, following in zip(numbers, batch["packed"], batch["next_packed"], strict=True):
                text, next_text = _text(packed), _text(following)
                rows.append(_row(sketch, doc_id, text, sketch(text), next_text, sketch(next_text)))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return stops.select("doc_id", "packed", "turn").join(starts, "turn").select("doc_id", "packed", "next_packed").mapInPandas(task, _SCHEMA)


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next); digests and fingerprints as bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _packed(docs).repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    done = written(_ranges(ordered), "fingerprints")
    whole = done.filter("last is null").unionByName(_joined_ends(done.filter("last is not null")))
    return whole.select(*_COLUMNS[:7])


def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    done = fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = {c: F.lower(F.hex(c)) for c in ("edited", "fingerprint", "edited_fingerprint")}
    return done.withColumns(text).withColumnRenamed("edited", "edited_sha256")
