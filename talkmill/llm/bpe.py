"""Byte-level BPE: DuckDB recursive queries in each task encode words and decode ids.

Every task holds a DuckDB database in memory with the merge table: (left id, right id) to the merged id,
whose number is its rank. The words that a batch adds are rows of (word, position, id); a recursive query
joins neighbouring positions with the merge table, contracts each word's leftmost pair of least rank,
and ends when no word has a pair left. The vocabulary is one list by id, of which each text's ids select
the letters that decode them.

A text is cut into words by the tokenizer's pattern. It is cut at blanks first, which are always word
borders when a non-space character follows, so the words of each piece are looked up once. Both caches
are bounded: beyond the bound they are emptied, which costs time, not results.

Words beyond LONG bytes contract all separate leftmost occurrences of their least pair in one round,
which leads to the same ids in far fewer rounds. Null texts count as empty; an empty text has no ids;
repeated rows give equal results; only id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, filterfalse

from pyspark.sql import DataFrame, SparkSession

from talkmill.llm.rows import narrow

LONG = 200
CACHED_PIECES, CACHED_WORDS = 400_000, 400_000
#: Texts of so many characters go through the database together.
TOGETHER = 1_000_000
MEMORY = "300MB"

#: White space as the tokenizer's pattern sees it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

ENCODE = """
WITH RECURSIVE step(k, round, id) AS (
  SELECT k, 0, id FROM word_bytes
  UNION ALL
  SELECT s.k - (s.k > best.cut)::bigint, s.round + 1, CASE WHEN s.k = best.cut THEN best.id ELSE s.id END
  FROM step s JOIN (
    SELECT a.k >> 20 AS word, min(m.id::bigint << 20 | (a.k & 1048575)) AS least,
           (least >> 20)::int AS id, word << 20 | (least & 1048575) AS cut
    FROM step a JOIN step b ON b.k = a.k + 1 JOIN merges m ON m.pair = a.id::bigint << 20 | b.id
    GROUP BY 1
  ) best ON s.k >> 20 = best.word
  WHERE s.k <> best.cut + 1
)
SELECT k >> 20 AS word, list(id ORDER BY k) AS ids FROM step
WHERE (k >> 20, round) IN (SELECT k >> 20, max(round) FROM step GROUP BY 1)
GROUP BY 1
"""

ENCODE_LONG = """
WITH RECURSIVE step(word, round, spot, id) AS (
  SELECT word, 0, spot, id FROM long_bytes
  UNION ALL
  SELECT word, round + 1, spot, CASE WHEN take THEN least ELSE id END
  FROM (
    SELECT *, coalesce(lag(take) OVER (PARTITION BY word ORDER BY spot), false) AS gone
    FROM (
      SELECT *, coalesce(merged = least, false) AND row_number() OVER (PARTITION BY word, merged = least, place - nth ORDER BY spot) % 2 = 1 AS take
      FROM (
        SELECT *, row_number() OVER (PARTITION BY word, merged = least ORDER BY spot) AS nth
        FROM (
          SELECT p.*, m.id AS merged, min(m.id) OVER (PARTITION BY word) AS least
          FROM (
            SELECT word, round, spot, id, lead(id) OVER w AS next, row_number() OVER w AS place
            FROM step WINDOW w AS (PARTITION BY word ORDER BY spot)
          ) p LEFT JOIN merges m ON m.pair = p.id::bigint << 20 | p.next
        ) WHERE least IS NOT NULL
      )
    )
  ) WHERE NOT gone
)
SELECT word, list(id ORDER BY spot) AS ids FROM step
WHERE (word, round) IN (SELECT word, max(round) FROM step GROUP BY 1)
GROUP BY 1
"""

DECODE = """
SELECT doc, array_to_string(list_select((SELECT letters FROM vocabulary), spots), '') AS letters FROM text_ids
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def letters_of(tokens: list[bytes]) -> list[str]:
    """Each byte as one character above the control characters, since tokens need not be valid text."""
    import numpy as np

    joined = (np.frombuffer(b"".join(tokens), np.uint8).astype("<u2") + 256).tobytes().decode("utf-16-le")
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def bytes_of(letters: str) -> bytes:
    return letters.encode("utf-16-le")[::2]


class Codec:
    """Encodes and decodes batches of texts; one for each task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import numpy as np
        import pyarrow as pa
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.cut = re.compile(f"(?= [^{SPACE}])")
        self.spaces = re.compile(f"[{SPACE}] (?:[{SPACE}]|\\Z)")
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        pairs = [
            (left << 20 | right, rank)
            for token, rank in ranks.items()
            for at in range(1, len(token))
            if (left := ranks.get(token[:at])) is not None and (right := ranks.get(token[at:])) is not None
        ]
        self.table("merges", pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "id": pa.array([i for _, i in pairs], pa.int32())}))
        by_id = sorted(ranks.items(), key=lambda item: item[1])
        self.ids = np.array([rank for _, rank in by_id], np.int32)
        self.table("vocabulary", pa.table({"letters": [letters_of([token for token, _ in by_id])]}))

    def table(self, name: str, rows) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def merge(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        import numpy as np
        import pyarrow as pa

        raw = [word.encode() for word in words]
        ids: dict[int, bytes] = {}
        for name, key, query, chosen in (
            ("word_bytes", True, ENCODE, [n for n, b in enumerate(raw) if len(b) <= LONG]),
            ("long_bytes", False, ENCODE_LONG, [n for n, b in enumerate(raw) if len(b) > LONG]),
        ):
            if not chosen:
                continue
            sizes = np.array([len(raw[n]) for n in chosen])
            number = np.repeat(np.array(chosen, np.int64), sizes)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            single = self.single[np.frombuffer(b"".join(raw[n] for n in chosen), np.uint8)]
            place = {"k": number << 20 | at} if key else {"word": number, "spot": at}
            self.db.register(name, pa.table(place | {"id": single}))
            out = self.db.sql(query).to_arrow_table()
            self.db.unregister(name)
            lists = out.column("ids").combine_chunks()
            flat, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            for n, a, b in zip(out.column("word").to_pylist(), ends[:-1], ends[1:], strict=True):
                ids[n] = flat[a:b].tobytes()
        return (ids[n] for n in range(len(words)))

    def cut_pieces(self, text: str) -> list[str]:
        """Pieces whose borders are word borders; joined they are the text."""
        if self.spaces.search(text):
            return [piece for piece in self.cut.split(text) if piece]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + piece for piece in rest]

    def split(self, pieces: list[str]) -> tuple[list[str], list[str], list[int]]:
        """The pieces in another order, the pattern's words of all of them end to end, and where each piece's words begin and end.

        Those with a blank in front and no other white space at their ends are cut in one go.
        """
        import numpy as np

        plain = [p for p in pieces if len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace()]
        words, edges = [], [0]
        for start in range(0, len(plain), 5000):
            some = plain[start : start + 5000]
            found = self.pattern.findall("".join(some))
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            edges += (np.searchsorted(ends, np.cumsum([len(p) for p in some])) + 1 + len(words)).tolist()
            words += found
        easy = set(plain)
        others = [p for p in pieces if p not in easy]
        for piece in others:
            words += self.pattern.findall(piece)
            edges.append(len(words))
        return plain + others, words, edges

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut_pieces(text) for text in texts]
        if len(self.pieces) > CACHED_PIECES:
            self.pieces = {}
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        known = self.pieces
        pieces, words, edges = self.split(list(dict.fromkeys(filterfalse(known.__contains__, chain.from_iterable(cut)))))
        fresh = list(dict.fromkeys(filterfalse(self.words.__contains__, words)))
        for start in range(0, len(fresh), 200_000):
            block = fresh[start : start + 200_000]
            self.words.update(zip(block, self.merge(block), strict=True))
        ids = list(map(self.words.__getitem__, words))
        # a piece of one word shares that word's ids
        known.update((piece, ids[a] if z - a == 1 else b"".join(ids[a:z])) for piece, a, z in zip(pieces, edges, edges[1:], strict=False))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa

        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        if not len(flat):
            return [b""] * len(ids)
        spots = np.searchsorted(self.ids, flat).astype(np.int32) + 1
        edges = np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int32)
        self.db.register("text_ids", pa.table({"doc": np.arange(len(ids), dtype=np.int32), "spots": pa.ListArray.from_arrays(edges, spots)}))
        out = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("text_ids")
        found = dict(zip(out.column("doc").to_pylist(), out.column("letters").to_pylist(), strict=True))
        return [bytes_of(found.get(n, "")) for n in range(len(ids))]


def blocks(texts: list[str], most: int = TOGETHER) -> Iterator[slice]:
    """Consecutive runs of texts of about so many characters."""
    start = size = 0
    for n, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield slice(start, n + 1)
            start, size = n + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): token ids of each whole text as little-endian unsigned 32-bit integers, and the decoded bytes.

    ranks_path is read by the driver; the vocabulary, a fixed file, is broadcast.
    """
    return _run(narrow(df, id_col, text_col), ranks_path, pattern, "doc_id long, ids binary, decoded binary", lambda ids, raw: (ids, raw))


def digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, with the digests of both in place of ids and bytes."""

    def digest(ids: bytes, raw: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()

    return _run(narrow(df, id_col, text_col), ranks_path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _run(docs: DataFrame, ranks_path: str, pattern: str, schema: str, row) -> DataFrame:
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    names = [part.split()[0] for part in schema.split(",")][1:]

    def task(batches):
        import pandas as pd

        codec = Codec(ranks.value, pattern)
        for batch in batches:
            texts = batch["text"].tolist()
            for part in blocks(texts):
                ids = codec.encode(texts[part])
                rows = [row(i, raw) for i, raw in zip(ids, codec.decode(ids), strict=True)]
                yield pd.concat([batch[["doc_id"]].iloc[part].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return docs.mapInPandas(task, schema)


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
