"""Collocations of two to five words, by stripes: each prefix keys a counter of the words that follow it.

A text is lower-cased (A-Z), cut into pieces and those into words; phrases lie within pieces. Level k counts the
phrases of k words: a task keeps stripes, (prefix of k - 1 words, counts by next word), which are merged
elementwise over all tasks. The stripe of the empty prefix holds the words, so its total is the number of words.
The merged stripes give the frequency of any part of a phrase, the largest extension to the right (the maximum of the
phrase's own stripe) and to the left (the maximum over entries that end in the phrase).

What a level counts is narrowed by the one before: a phrase is seen at least MIN times only if both the phrase
without its last word and the one without its first are. Tasks test this on a bitmap of BITS bits,
broadcast, whose size never changes; a full one narrows less, but counts are exact and the threshold
is applied to them. In a task words are told apart by hashes of 64 bits, between tasks by their letters. The stripe of a prefix seen HOT times or more, which a second bitmap tells, is dealt out by its next
words, so no prefix is gathered whole. Tasks hold at most ROWS phrases and WORDS words, then pass on what they counted.

Scores multiply counts as decimals of 38 digits. Whether a longer phrase takes in a shorter one
is seen from phrases longer by one word: between the two lies a chain of phrases at least as frequent as the longer.

Null texts and empty ones have no words; a null language is ``und``; rows that repeat count again; an
empty table gives no rows; only text and language columns are read. Words may be of any length, as may texts: a text is
handled in blocks of whole pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from talkmill.llm.components import written
from talkmill.llm.rows import text_or_empty

LONGEST = 5
MIN = 100
#: Percent of a phrase's occurrences that a longer one must reach to take it in.
SUBSUMED = 100
TOP = 2000
BITS = 26
HOT = 100_000
SHARDS = 64
#: Parts that stripes are dealt to.
PARTS = 4096
ROWS = 1_500_000
WORDS = 400_000
#: Bytes of text cut into words at a time.
BLOCK = 2_000_000
#: Words of more bytes are hashed one by one.
LONG = 64
UNKNOWN = "und"

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_UPPER + _ENDS + b"\t", _LOWER + b"\n" * len(_ENDS) + b" ")
_TURN = 13
#: A word that no text has, as it ends a piece.
_TOTAL = "\r"
_LANGUAGE_TURN = 5


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_hash(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw)


class Hasher:
    """Finds the words of a folded block and hashes all at once, as polynomials over their bytes modulo 2**64."""

    _BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) <= size:
            steps = np.full(size + 1, self._BASE, np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = pow(self._BASE, -1, 1 << 64)
            self.inverse = np.cumprod(steps, dtype=np.uint64)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where words begin and end, the number of their piece, and their hashes."""
        letters = np.frombuffer(data, np.uint8)
        ends_piece = letters == 10
        blank = np.ones(len(letters) + 2, bool)
        blank[1:-1] = ends_piece | (letters == 32)
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        piece = np.searchsorted(np.flatnonzero(ends_piece), starts)
        self._grow(len(letters))
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * self.powers[: len(letters)], out=sums[1:])
        hashes = _mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        for k in np.flatnonzero(ends - starts > LONG):
            hashes[k] = text_hash(data[starts[k] : ends[k]])
        return starts, ends, piece, hashes


def phrase_hashes(hashes: np.ndarray, length: int, begin: np.uint64) -> np.ndarray:
    """Hash of the words from each place on: exclusive or of the words' hashes, each turned by its place, and the language's."""
    count = len(hashes) - length + 1
    whole = np.full(max(count, 0), begin, np.uint64)
    for k in range(length):
        whole ^= _turned(hashes[k : k + count], k * _TURN)
    return whole


def language_hash(language: str) -> np.uint64:
    return _turned(np.array([text_hash(language.encode())], np.uint64), _LANGUAGE_TURN)[0]


def blocks(data: bytes, most: int = BLOCK) -> Iterator[bytes]:
    """Consecutive blocks of whole pieces, of about so many bytes."""
    start = 0
    while start < len(data):
        end = data.find(b"\n", start + most)
        end = len(data) if end < 0 else end
        yield data[start:end]
        start = end + 1


@dataclass
class Known:
    """What the level before found: bits of frequent phrases, then bits of hot ones."""

    bits: np.ndarray

    def _test(self, slot: np.ndarray) -> np.ndarray:
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

    def frequent(self, hashes: np.ndarray) -> np.ndarray:
        return self._test((hashes >> np.uint64(64 - BITS)).astype(np.int64))

    def hot(self, hashes: np.ndarray) -> np.ndarray:
        return self._test((hashes >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS))


class Stripes:
    """Counts phrases of one length in a task."""

    def __init__(self, length: int, known: Known | None):
        self.length, self.known = length, known
        self.languages: dict[str, int] = {}
        self.hasher = Hasher()
        self._clear()

    def _clear(self) -> None:
        self.number: dict[int, int] = {}
        self.names: list[bytes] = []
        self.rows = [np.empty((0, self.length + 1), np.int32)]
        self.counts = [np.empty(0, np.int64)]
        self.held = 0

    def _numbers(self, data: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of distinct words in this task, given out as they are met."""
        out = np.empty(len(hashes), np.int64)
        for k, h in enumerate(hashes.tolist()):
            number = self.number.get(h)
            if number is None:
                number = self.number[h] = len(self.names)
                self.names.append(data[starts[k] : ends[k]])
            out[k] = number
        return out

    def add(self, language: str, data: bytes) -> Iterator:
        """Counts a block of folded text; yields batches when the bound is met."""
        starts, ends, piece, hashes = self.hasher(data)
        if self.length == 1:
            distinct, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            words = self._numbers(data, distinct, starts[first], ends[first])[:, None]
        else:
            at = self._places(language, piece, hashes)
            used = np.zeros(len(hashes), bool)
            for k in range(self.length):
                used[at + k] = True
            place = np.cumsum(used) - 1
            used = np.flatnonzero(used)
            distinct, first, inverse = np.unique(hashes[used], return_index=True, return_inverse=True)
            numbers = self._numbers(data, distinct, starts[used[first]], ends[used[first]])[inverse] if len(used) else inverse
            words = np.stack([numbers[place[at + k]] for k in range(self.length)], axis=1)
            counts = np.ones(len(at), np.int64)
        rows = np.empty((len(words), self.length + 1), np.int32)
        rows[:, 0] = self.languages.setdefault(language, len(self.languages))
        rows[:, 1:] = words
        self.rows.append(rows)
        self.counts.append(counts)
        self.held += len(rows)
        if self.held > ROWS or len(self.names) > WORDS:
            self._merge()
            if self.held > ROWS // 2 or len(self.names) > WORDS:
                yield from self.flush()

    def _places(self, language: str, piece: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Where the phrases to count begin."""
        shorter = self.length - 1
        count = len(hashes) - shorter
        if count <= 0:
            return np.empty(0, np.int64)
        good = self.known.frequent(phrase_hashes(hashes, shorter, language_hash(language)))
        return np.flatnonzero(good[:-1] & good[1:] & (piece[:count] == piece[shorter:]))

    def _merge(self) -> None:
        """Equal phrases added up, in the order of their numbers: a stripe's entries are neighbours."""
        rows, counts = np.concatenate(self.rows), np.concatenate(self.counts)
        if not len(rows):
            return
        key, most = rows[:, 0].astype(np.int64), len(self.languages)
        for k in range(1, self.length + 1):
            if most * len(self.names) >= 1 << 62:
                found, key = np.unique(key, return_inverse=True)
                most = len(found)
            key = key * len(self.names) + rows[:, k]
            most *= len(self.names)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.rows, self.counts = [rows[order[first]]], [np.add.reduceat(counts[order], first)]
        self.held = len(first)

    def flush(self) -> Iterator:
        """(part, lang, stripes, n) in batches: a row holds the stripes of a language that fall to one part.

        A stripe is its prefix, a tab and the next words; n are the counts in the same order. The part of a stripe follows
        from its prefix, for a hot one from the next word as well. The number of all words is under the prefix _TOTAL.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        self._merge()
        rows, counts = np.concatenate(self.rows), np.concatenate(self.counts)
        if not len(rows):
            return
        names = pa.array(self.names, pa.string())
        languages = pa.array(list(self.languages), pa.string())
        hashes = np.fromiter(self.number, np.uint64, len(self.number))
        prefix = rows[:, :-1]
        group = np.cumsum(np.concatenate([[True], (prefix[1:] != prefix[:-1]).any(axis=1)]))
        shard = hashes[rows[:, -1]] % np.uint64(SHARDS)
        whole = np.array([language_hash(language) for language in self.languages], np.uint64)[prefix[:, 0]]
        if self.length > 1:
            for k in range(1, self.length):
                whole = whole ^ _turned(hashes[prefix[:, k]], (k - 1) * _TURN)
            shard[~self.known.hot(whole)] = 0
        part = (_mixed(whole + shard) % np.uint64(PARTS)).astype(np.int32)
        order = np.lexsort((group, prefix[:, 0], part))
        rows, counts, part, group = rows[order], counts[order], part[order], group[order]
        new_row = np.concatenate([[True], (part[1:] != part[:-1]) | (rows[1:, 0] != rows[:-1, 0])])
        new_stripe = new_row | np.concatenate([[True], group[1:] != group[:-1]])
        first = np.flatnonzero(new_stripe)
        stripe_ends = pa.array(np.append(first, len(rows)).astype(np.int32))
        nexts = pc.binary_join(pa.ListArray.from_arrays(stripe_ends, names.take(pa.array(rows[:, -1]))), " ")
        words = [names.take(pa.array(rows[first, k])) for k in range(1, self.length)]
        before = pc.binary_join_element_wise(*words, " ") if words else pa.array([""] * len(first))
        texts = pc.binary_join_element_wise(before, nexts, "\t")
        row_ends = np.flatnonzero(new_row)
        stripe_of = np.append(np.cumsum(new_stripe)[row_ends] - 1, len(first)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(stripe_of), texts), "\n")
        numbers = pa.ListArray.from_arrays(pa.array(np.append(row_ends, len(rows)).astype(np.int32)), pa.array(counts))
        out = ["part", "lang", "stripes", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(part[row_ends]), languages.take(pa.array(rows[row_ends, 0])), lines, numbers], out)
        if self.length == 1:
            sums = np.bincount(rows[:, 0], counts, len(self.languages)).astype(np.int64)
            met = np.flatnonzero(sums)
            single = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1, dtype=np.int32)), pa.array(sums[met]))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(met), np.int32)), languages.take(pa.array(met)), pa.array([f"{_TOTAL}\t{_TOTAL}"] * len(met)), single], out)
        self._clear()


def stripes(docs: DataFrame, length: int, known: np.ndarray | None = None) -> DataFrame:
    """(lang, prefix, next, f): merged stripes of all phrases of (lang, text) that can be frequent.

    For words, prefix is empty, and a row with a null prefix holds the number of all words.
    """
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def task(batches):
        counter = Stripes(length, None if shared is None else Known(shared.value))
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.setdefault(language, []).append(text.encode())
            for language, some in texts.items():
                for block in blocks(b"\n".join(some).translate(_FOLD)):
                    yield from counter.add(language, block)
        yield from counter.flush()

    kept = docs.mapInArrow(task, "part int, lang string, stripes string, n array<long>").repartition("part")
    # Each stripe is split once: into its prefix and its words, held in a list of one.
    entries = """flatten(flatten(transform(split(stripes, '\n', -1), s -> transform(array(split(s, '\t')),
        t -> transform(split(t[1], ' '), w -> struct(t[0] as prefix, w as next))))))"""
    dealt = kept.select("part", "lang", F.explode(F.arrays_zip(F.expr(entries).alias("e"), F.col("n").alias("n"))).alias("x"))
    merged = dealt.groupBy("part", "lang", F.col("x.e.prefix").alias("prefix"), F.col("x.e.next").alias("next")).agg(F.sum("x.n").alias("f"))
    return merged.select("lang", F.when(F.col("prefix") != _TOTAL, F.col("prefix")).alias("prefix"), "next", "f")


def _bitmap(frequent: DataFrame, length: int) -> np.ndarray | None:
    """Bits of the hashes of phrases of one length, put together by Spark in segments; None without any phrase."""

    def task(batches):
        import pyarrow as pa

        hasher = Hasher()
        for batch in batches:
            if not batch.num_rows:
                continue
            language, phrase, f = (batch.column(k).to_pylist() for k in range(3))
            hashes = hasher("\n".join(phrase).encode())[3]
            begins = np.array([language_hash(x) for x in language], np.uint64)
            whole = phrase_hashes(hashes, length, np.uint64(0))[::length] ^ begins
            slots = (whole >> np.uint64(64 - BITS)).astype(np.int64)
            hot = slots[np.array(f) >= HOT] + (1 << BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([slots, hot]))], ["slot"])

    slots = frequent.select("lang", "phrase", "f").mapInArrow(task, "slot long")
    parts = slots.groupBy(F.shiftright("slot", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("bits"))
    found = parts.collect()
    if not found:
        return None
    bits = np.zeros(1 << (BITS - 2), np.uint8)
    for part, raw in found:
        bits[part << 12 : (part + 1) << 12] = np.frombuffer(bytes(raw), np.uint8)
    return bits


def frequent_phrases(docs: DataFrame, least: int = MIN, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, k, prefix, next, phrase, f) of phrases seen least times or more, (lang, n) of all words)."""
    levels, known, totals = [], None, None
    for length in range(1, longest + 1):
        merged = stripes(docs, length, known).filter((F.col("f") >= least) | F.col("prefix").isNull())
        phrase = F.col("next") if length == 1 else F.concat_ws(" ", "prefix", "next")
        level = written(merged.select("lang", F.lit(length).alias("k"), "prefix", "next", phrase.alias("phrase"), "f"), f"stripes-{length}")
        if length == 1:
            totals = level.filter("prefix is null").select("lang", F.col("f").alias("n"))
            level = level.filter("prefix is not null")
        levels.append(level)
        known = _bitmap(level, length) if length < longest else None
        if known is None:
            break
    frequent = levels[0]
    for level in levels[1:]:
        frequent = frequent.union(level)
    return frequent, totals


def _largest_extension(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, most): how often the most frequent phrase is seen that is one word longer."""
    right = frequent.filter("k > 2").select("lang", F.col("prefix").alias("phrase"), "f")
    left = frequent.filter("k > 2").selectExpr("lang", "substr(phrase, instr(phrase, ' ') + 1) as phrase", "f")
    return right.union(left).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def _first(df: DataFrame, top: int) -> DataFrame:
    """The first rows of each language; each is ranked among a share of them first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARDS))).orderBy(*order)
    few = df.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col("rank") <= top)


def collocations(
    df: DataFrame,
    least: int = MIN,
    subsumed: int = SUBSUMED,
    top: int | None = TOP,
    longest: int = LONGEST,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of phrases not taken in by a longer one; all of them, without rank, if top is None."""
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(text_col).alias("text"))
    frequent, totals = frequent_phrases(docs, least, longest)
    candidates = frequent.filter("k > 1").select("lang", "phrase", F.col("f").alias("a"))
    kept = candidates.join(_largest_extension(frequent), ["lang", "phrase"], "left").filter(F.expr(f"coalesce(100 * most < {subsumed} * a, true)"))
    words = kept.select("lang", "phrase", "a", F.split("phrase", " ", -1).alias("w"))
    cuts = words.select("lang", "phrase", "a", "w", F.expr("explode(sequence(1, size(w) - 1)) as cut"))
    sides = cuts.selectExpr("lang", "phrase", "a", "cut", "array_join(slice(w, 1, cut), ' ') as first", "array_join(slice(w, cut + 1, size(w)), ' ') as rest")
    seen = frequent.select("lang", F.col("phrase").alias("part"), F.col("f").alias("times"))
    both = (
        sides.join(seen.withColumnsRenamed({"part": "first", "times": "l"}), ["lang", "first"])
        .join(seen.withColumnsRenamed({"part": "rest", "times": "r"}), ["lang", "rest"])
        .join(totals, "lang")
    )
    wide = {c: f"cast({c} as decimal(19, 0))" for c in "alrn"}
    score = f"cast(cast(1000 as decimal(4, 0)) * ({wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']}) as bigint)"
    scored = both.withColumn("score", F.expr(score))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    rows = worst.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    if top is None:
        return rows
    return _first(rows, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of every language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every phrase by every place it has, all of a language's counts side by side: for a few thousand documents.
COLLOCATIONS_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), worded AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece
), total AS (
  SELECT lang, sum(len(w))::bigint AS n FROM worded GROUP BY lang
), seen AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM worded, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k
  ) GROUP BY ALL HAVING count(*) >= 100
), taken AS (
  SELECT DISTINCT s.lang, s.phrase FROM seen s JOIN seen t ON t.lang = s.lang AND t.k > s.k
    AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * t.f >= 100 * s.f
  WHERE s.k > 1
), cuts AS (
  SELECT s.lang, s.phrase, s.f AS a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM seen WHERE k > 1) s
  ANTI JOIN taken t ON t.lang = s.lang AND t.phrase = s.phrase
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.c, x.f AS l, y.f AS r, t.n, ((1000::hugeint * c.a * t.n) // (x.f::hugeint * y.f))::bigint AS score
  FROM cuts c JOIN seen x ON x.lang = c.lang AND x.phrase = c.x JOIN seen y ON y.lang = c.lang AND y.phrase = c.y JOIN total t ON t.lang = c.lang
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst QUALIFY rank <= 2000
"""
