"""Suffix-array dedup: every byte covered by a LENGTH-byte string that also starts elsewhere goes.

1. Each string of LENGTH bytes of a text has an anchor: its least GRAM by hash, the leftmost of equals. Equal strings
   have equal anchors at equal offsets, and neighbouring strings share one, so a text has an anchor for every 170 bytes or so.
2. Anchors whose GRAM stands nowhere else are done: counted by hash, in one shuffle of numbers.
3. The others have a context: all strings of the anchor, 400 to 736 bytes, known by a digest. Equal contexts are merged by it, with
   their number: those that start close together in a text as they are found, all others in one shuffle of digests.
   A context that has its GRAM to itself is settled, as all its strings have copies. Of the others, one text each brings the bytes. What
   is left of one GRAM is sorted from the anchor rightwards and, reversed, leftwards, by deep-shallow sorting.
   Neighbours' common prefixes tell for each offset which contexts have the same string there.
4. A GRAM with more than MOST contexts (a passage that a third of all texts share, in as many surroundings) is taken apart: its strings
   go by runs of offsets, then by one, to groups with an equal core, where equal contexts merge again, by digests. A group of single
   strings is equal throughout, so it is only counted. No string is dropped and no pairs are made.
5. Repeated strings come back to each text that has the context, and their bytes are cut out.

Strings are judged on the input, never across texts; rows that repeat both id and text are occurrences each. Null texts count as empty;
texts under LENGTH bytes stay as they are. Only the id and text columns are read. Texts travel compressed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill.llm.components import written
from talkmill.llm.deep_shallow import common_prefix, sort_strings
from talkmill.llm.jaccard import _groups_of

LENGTH = 400
GRAM = 64
MOST = 2048
#: Offsets of a run when a group is taken apart.
RUNS = (16, 1)
CHUNK = 1 << 20

_M = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the gram (a power of two) that starts at each byte, by doubling."""
    x = data.astype(np.uint64) + np.uint64(1)
    x *= _M
    x ^= x >> np.uint64(29)
    factor, size = 0xD6E8FEB86659FD93, 1
    while size < gram:
        x = x[:-size] * np.uint64(factor) + x[size:]
        factor = factor * factor % 2**64
        size *= 2
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last): each anchor with the first and last start of the strings it stands for."""
    if len(data) < length:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    out = []
    for base in range(0, len(data) - length + 1, CHUNK):
        part = data[base : base + CHUNK + length - 1]
        hashes = gram_hashes(part, gram)
        low = (hashes >> np.uint64(28) << np.uint64(28)) | np.arange(len(hashes), dtype=np.uint64)
        width, size = length - gram + 1, 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        place = (low & np.uint64((1 << 28) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        out.append((hashes[place[first]], place[first] + base, first + base, last + base))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _data(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _packed(docs: DataFrame) -> DataFrame:
    def task(batches):
        for batch in batches:
            yield batch.assign(packed=[zlib.compress(_data(t), 1) for t in batch["text"]])[["key", "doc_id", "packed"]]

    return docs.mapInPandas(task, "key string, doc_id long, packed binary")


def _name(context: bytes, anchor: int) -> bytes:
    """A digest of a context with its anchor's byte."""
    return hashlib.blake2b(context, digest_size=16, salt=anchor.to_bytes(4, "little")).digest()


def named_anchors(data: bytes, length: int = LENGTH) -> dict[str, list]:
    """Columns gram, name, anchor, width, first, far, times of a text's contexts, which begin at first and have width + 1 strings.

    Equal contexts that begin at most length apart (texts that repeat a word have one every few bytes) are one row: with
    the first and the farthest of times starts they cover the same bytes.
    """
    gram, place, first, last = (x.tolist() for x in anchors(np.frombuffer(data, np.uint8), length))
    out: dict[str, list] = {c: [] for c in _FOUND[:-1]}
    row_of: dict[bytes, int] = {}
    for g, p, a, z in zip(gram, place, first, last, strict=True):
        name = _name(data[a : z + length], p - a)
        row = row_of.get(name)
        if row is not None and a - out["far"][row] <= length:
            out["far"][row] = a
            out["times"][row] += 1
            continue
        row_of[name] = len(out["gram"])
        for column, value in zip(out.values(), (g - 2**64 if g >> 63 else g, name, p - a, z - a, a, a, 1), strict=True):
            column.append(value)
    return out


_FOUND = ["gram", "name", "anchor", "width", "first", "far", "times", "key"]


def _anchors_of(docs: DataFrame, length: int) -> DataFrame:
    def task(batches):
        import pandas as pd

        for batch in batches:
            rows: dict[str, list] = {c: [] for c in _FOUND}
            for key, text in zip(batch["key"], batch["text"], strict=True):
                for column, values in named_anchors(_data(text), length).items():
                    rows[column] += values
                rows["key"] += [key] * (len(rows["gram"]) - len(rows["key"]))
                if len(rows["key"]) > 20_000:
                    yield pd.DataFrame(rows)
                    rows = {c: [] for c in _FOUND}
            if rows["key"]:
                yield pd.DataFrame(rows)

    return docs.select("key", "text").mapInPandas(task, "gram long, name binary, anchor int, width int, first int, far int, times long, key string")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """(core, name, context, anchor, copies): the bytes of contexts, which hold all strings of an anchor; it stands at byte anchor of them."""

    def task(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for packed, spots in zip(batch["packed"], batch["spots"], strict=True):
                data = zlib.decompress(packed)
                for s in spots:
                    rows.append((s["core"], s["name"], data[s["first"] : s["first"] + s["width"] + length], s["anchor"], s["copies"]))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=_CONTEXT)
                    rows = []
            yield pd.DataFrame(rows, columns=_CONTEXT)

    return texts.select("packed", "spots").mapInPandas(task, "core long, name binary, context binary, anchor int, copies long")


_CONTEXT = ["core", "name", "context", "anchor", "copies"]


def repeated_offsets(contexts: list[bytes], anchor: np.ndarray, copies: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each context, the inclusive ranges of its string starts whose string another one, or a copy, also has.

    All contexts are aligned at their anchors; those of one anchor share GRAM bytes from there on.
    """
    grams = {c[p : p + GRAM] for c, p in zip(contexts, anchor.tolist(), strict=True)}
    known = len(min(grams, key=len)) if len(grams) == 1 else 0
    high = anchor  # the largest distance from a string's start to the anchor, and the least
    low = anchor - (np.array([len(c) for c in contexts]) - length)
    if len(contexts) == 1:
        return [[(0, int(high[0] - low[0]))] if copies[0] > 1 else []]
    if len(contexts) == 2:
        (a, b), (p, q) = contexts, anchor.tolist()
        ahead = common_prefix(a[p:], b[q:], known)
        back = common_prefix(a[:p][::-1], b[:q][::-1])
        start, end = max(int(low.max()), length - ahead), min(int(high.min()), back)
        shared = [(start, end)] if start <= end else []
        return [_starts(high[k], [(int(low[k]), int(high[k]))] if copies[k] > 1 else shared) for k in range(2)]
    order_r, prefix_r = sort_strings([c[p:] for c, p in zip(contexts, anchor, strict=True)], known)
    order_l, prefix_l = sort_strings([c[:p][::-1] for c, p in zip(contexts, anchor, strict=True)])
    # between these distances nothing changes: who has such a string, and whose bytes agree on either side
    turns = np.unique(np.concatenate([low, high + 1, prefix_l + 1, length - prefix_r]))
    turns = turns[(turns >= low.min()) & (turns <= high.max())]
    ranges: list[list[tuple[int, int]]] = [[] for _ in contexts]
    left, right = np.empty(len(contexts), np.int64), np.empty(len(contexts), np.int64)
    for k, turn in enumerate(turns.tolist()):
        left[order_l] = np.cumsum(prefix_l < turn)
        right[order_r] = np.cumsum(prefix_r < length - turn)
        here = np.flatnonzero((low <= turn) & (turn <= high))
        if not len(here):
            continue
        _, group = np.unique(left[here] * (len(contexts) + 1) + right[here], return_inverse=True)
        end = int(turns[k + 1]) - 1 if k + 1 < len(turns) else int(high.max())
        for n in here[np.bincount(group, copies[here])[group] > 1].tolist():
            if ranges[n] and ranges[n][-1][1] == turn - 1:
                ranges[n][-1] = (ranges[n][-1][0], end)
            else:
                ranges[n].append((turn, end))
    return [_starts(high[n], r) for n, r in enumerate(ranges)]


def _starts(high: int, distances: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of distances to the anchor as ranges of starts in the context."""
    return [(int(high) - end, int(high) - start) for start, end in distances]


_RANGES = "name binary, ranges array<struct<start:int,end:int>>"


def _judge(groups: DataFrame, length: int) -> DataFrame:
    """(name, ranges) of contexts (core, name, context, anchor, copies) that come grouped by core."""

    def task(batches):
        import pandas as pd

        names, found = [], []
        for rows in _groups_of(batches, "core"):
            for name, ranges in zip(rows["name"], repeated_offsets(list(rows["context"]), rows["anchor"].astype(np.int64), rows["copies"], length), strict=True):
                if ranges:
                    names.append(name)
                    found.append([{"start": a, "end": b} for a, b in ranges])
            if len(names) > 5000:
                yield pd.DataFrame({"name": names, "ranges": found})
                names, found = [], []
        if names:  # empty lists would be a column of numbers, which Arrow can't take for ranges
            yield pd.DataFrame({"name": names, "ranges": found})

    return groups.repartition("core").sortWithinPartitions("core").mapInPandas(task, _RANGES)


def _taken_apart(large: DataFrame, length: int, run: int) -> DataFrame:
    """(core, name, anchor, width, copies, whole, shift): parts of contexts with run distances each, named anew; whole and shift tell where each came from."""

    def task(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for core, context, anchor, copies, whole, shift in zip(batch["core"], batch["context"], batch["anchor"], batch["copies"], batch["whole"], batch["shift"], strict=True):
                most, least = anchor, anchor - (len(context) - length)
                for turn in range(least // run, most // run + 1):
                    a, b = max(least, turn * run), min(most, turn * run + run - 1)
                    part = context[anchor - b : anchor - a + length]
                    shared = context[anchor - turn * run : anchor - (turn * run + run - 1) + length]  # of all strings of the run
                    group = hashlib.blake2b(shared, digest_size=8, key=f"{core}/{turn}".encode()).digest()
                    rows.append((int.from_bytes(group, "little", signed=True), _name(part, b), b, b - a, copies, whole, shift + anchor - b))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=_PART)
                    rows = []
            yield pd.DataFrame(rows, columns=_PART)

    return large.mapInPandas(task, "core long, name binary, anchor int, width int, copies long, whole binary, shift int")


_PART = ["core", "name", "anchor", "width", "copies", "whole", "shift"]


def _bytes_of(parts: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """Parts with their bytes, cut from the contexts they came from."""
    whole = contexts.select(F.col("name").alias("whole"), F.col("context").alias("bytes"))
    met = parts.join(whole, "whole").withColumn("context", F.substring("bytes", F.col("shift") + 1, F.col("width") + length))
    return met.select(*parts.columns, "context")


_ALL = "array(named_struct('start', 0, 'end', width)) AS ranges"


def _repeated(contexts: DataFrame, large: DataFrame, length: int, most: int) -> DataFrame:
    """(name, start, end) of repeated strings in contexts (core, name, context, anchor, copies); large: (core) of those with more than most."""
    spans = lambda df, *more: df.select("name", F.explode("ranges").alias("r"), *more)
    out = spans(_judge(contexts.join(large, "core", "left_anti"), length)).select("name", "r.start", "r.end")
    rest = contexts.join(large, "core").select("core", "context", "anchor", "copies", F.col("name").alias("whole"), F.lit(0).alias("shift"))
    for run in RUNS:
        if not large.head(1):
            break
        parts = written(_taken_apart(rest, length, run), f"runs-{run}")
        again = parts.groupBy("core", "name").agg(F.sum("copies").alias("copies"), F.first(F.struct("anchor", "width", "whole", "shift")).alias("at"))
        again = written(again.select("core", "name", "copies", "at.*"), f"merged-{run}")
        if run > 1:
            several = written(_several(again), f"several-{run}")
            large = written(several.filter(F.col("contexts") > most).select("core"), f"large-{run}")
            met = again.join(several.filter(F.col("contexts") <= most).select("core"), "core")
            alone = again.join(several, "core", "left_anti").filter("copies > 1")
            found = _judge(_bytes_of(met, contexts, length), length).union(alone.selectExpr("name", _ALL))
        else:  # single strings, equal in each group
            found = again.filter("copies > 1").selectExpr("name", _ALL)
        back = spans(written(found, f"found-{run}")).join(parts.select("name", "whole", "shift"), "name")
        out = out.union(back.select(F.col("whole").alias("name"), (F.col("r.start") + F.col("shift")).alias("start"), (F.col("r.end") + F.col("shift")).alias("end")))
        if run > 1:
            rest = _bytes_of(parts.join(large, "core"), contexts, length).select("core", "context", "anchor", "copies", "whole", "shift")
    return out


def _several(merged: DataFrame) -> DataFrame:
    """(core, contexts) where more than one context has the core."""
    return merged.groupBy("core").agg(F.count("*").alias("contexts")).filter("contexts > 1")


def _cut(texts: DataFrame, keep_text: bool) -> DataFrame:
    """Rows of texts (key, doc_id, packed, spans) without the bytes of their spans."""

    def task(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            numbers = batch["doc_id"].astype("object").where(batch["doc_id"].notna(), None)
            for key, doc_id, packed, spans in zip(batch["key"], numbers, batch["packed"], batch["spans"], strict=True):
                data = zlib.decompress(packed)
                runs: list[list[int]] = []
                for start, end in sorted((s["start"], s["end"]) for s in spans) if spans is not None else ():
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                at, kept = 0, []
                for start, end in runs:
                    kept.append(data[at:start])
                    at = end
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append((key, doc_id, len(data), len(data) - len(left), len(runs), left if keep_text else hashlib.sha256(left).digest()))
            yield pd.DataFrame(rows, columns=["key", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.mapInPandas(task, "key string, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def drop_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int = MOST, keep_text: bool = True) -> DataFrame:
    """(key, doc_id, n_bytes, n_removed, n_spans, kept), a row for each row of df; kept: the bytes left, or their SHA-256.

    Repeated rows with the same id and text are occurrences each: their common key is numbered.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.hex(F.xxhash64(text)))
    docs = df.select(name.alias("key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    found = written(_anchors_of(docs, length), "anchors")
    # a table of its own, so that both sides of the join are dealt out for it and a hot gram can be split
    often = written(found.groupBy("gram").agg(F.sum("times").alias("n")).filter("n > 1").select("gram"), "grams")
    spots = written(found.join(often, "gram"), "spots")
    merged = spots.groupBy(F.col("gram").alias("core"), "name").agg(F.sum("times").alias("copies"), F.first(F.struct("anchor", "width", "key", "first")).alias("at"))
    merged = written(merged.select("core", "name", "copies", "at.*"), "merged-contexts")
    several = written(_several(merged), "several")
    # bytes of one text for each context that has others to be compared with; a context alone with its gram has equal copies only
    wanted = merged.join(several.select("core"), "core").groupBy("key").agg(F.collect_list(F.struct("core", "name", "first", "width", "anchor", "copies")).alias("spots"))
    packed = _packed(docs)
    texts = packed.groupBy("key").agg(F.first("packed").alias("packed"))  # repeated rows have one key
    contexts = written(_contexts(texts.join(wanted, "key"), length), "contexts")
    large = written(several.filter(F.col("contexts") > most).select("core"), "large-grams")
    alone = merged.join(several, "core", "left_anti").select("name", F.lit(0).alias("start"), F.col("width").alias("end"))
    repeated = _repeated(contexts, large, length, most).union(alone)
    spans = spots.select("name", "key", "first", "far").join(repeated, "name").select("key", (F.col("first") + F.col("start")).alias("start"), (F.col("far") + F.col("end") + length).alias("end"))
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return _cut(packed.join(spans, "key", "left"), keep_text)


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suffix-array dedup leaves of each document."""
    done = drop_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


#: Every 400-byte string by its digest, over texts in hexadecimal: for tables of a few thousand documents.
SUFFIX_SQL = """
WITH letters AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS MATERIALIZED (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS s
  FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 399)) AS i FROM letters WHERE len(h) >= 800)
), repeated AS (
  SELECT doc_id, i FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)
), marked AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER w + 400, true) AS new FROM repeated WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT doc_id, i, sum(new::int) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), runs AS MATERIALIZED (
  SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM numbered GROUP BY ALL
), edges AS (
  SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS z FROM runs
  UNION ALL
  SELECT d.doc_id, coalesce(max(r.z), 0), any_value(len(d.h) // 2) FROM letters d LEFT JOIN runs r USING (doc_id) GROUP BY d.doc_id
), kept AS (
  SELECT doc_id, sha256(from_hex(string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a))) AS kept_sha256
  FROM edges JOIN letters USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM letters d JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(z - a)::bigint AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id) r USING (doc_id)
"""
