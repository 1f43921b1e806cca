"""N-gram Jaccard join: classes of documents linked by shingle sets with a share of 0.8 or more, by signature trees.

1. Each text becomes its set of distinct 5-word shingles (hashed; fewer words make one shingle, none make
   an empty set that links with nothing). Equal sets are one class and count once from here on.
2. Two sets with a share s have a common token among the first n - ceil(s n) + 1 of each, in any order that
   holds for all. Tokens found often come last in it; the rest are ordered by hash. How often a token must be
   seen, and how many such tokens are kept, are parameters of the order: they change speed, never results.
3. The sets of a prefix token are a bucket. Buckets with the same members are one. In each, a signature tree
   joins sets whose bitmaps allow a link; a bucket sends on at most one edge per member. Buckets of frequent
   tokens are not compared: their members, mostly copies of one text, are put together, salted, in two steps.
4. The components of these edges hold every link. Within each, signature trees over whole sets find
   the links, every one checked on the sets; a pair already connected is left out, so a group of thousands
   of copies is not compared pair by pair. Components over a weight are dealt out as pairs of blocks,
   whose sizes allow a link, so memory stays bounded.
5. The components of the links are the classes.

Null texts count as empty. Rows that repeat get equal results. A class without an id has a null component.
Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from talkmill.llm.components import components, written
from talkmill.llm.rows import row_key
from talkmill.llm.signature_tree import Groups, bitmap, fold, group_by_bitmaps, may_link, needed, words_for

SHINGLE = 5
SHARE = 80
#: Order of tokens: seen so often at least, and so many of them at most.
FREQUENT, MOST_FREQUENT = 100, 100_000
#: Tokens counted together in a task before the counts that matter go on.
COUNTED = 2_000_000
SALTS = 64
#: Most 64-bit words of a bitmap that travels with a bucket's member: two bits a token up to 32,768 tokens.
BUCKET_WORDS = 1024
#: Members of a bucket compared together; a larger bucket is put together as a whole.
MOST_MEMBERS = 4096
#: Tokens of a component's block.
BLOCK = 4_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes.

    A word's hash is the sum of its bytes times a factor for their place in the word, for all words of a text at once.
    """

    #: The six bytes between words: blank, tab, line feed, vertical tab, form feed, carriage return.
    BETWEEN = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

    def __init__(self, size: int = SHINGLE):
        self.size, self.factors = size, np.empty(0, np.uint64)

    def words(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)  # of bytes: ASCII only
        between = self.BETWEEN[data]
        first = ~between
        first[1:] &= between[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.empty(0, np.uint64)
        place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
        longest = int(place.max()) + 1
        if longest > len(self.factors):
            self.factors = _mixed(np.arange(1, 2 * longest + 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        value = (data.astype(np.uint64) + np.uint64(1)) * self.factors[place]
        value[between] = 0
        return _mixed(np.add.reduceat(value, starts))

    def __call__(self, text: str) -> np.ndarray:
        hashes = self.words(text)
        if not len(hashes):
            return hashes
        size = min(self.size, len(hashes))
        count = len(hashes) - size + 1
        mixed = np.full(count, size, np.uint64)
        for k in range(size):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
        found = np.sort(_mixed(mixed))
        return found[np.r_[True, found[1:] != found[:-1]]]


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _node(name: bytes) -> int:
    """A set's number among candidates. Equal numbers of unequal sets only make candidates coarser."""
    return int.from_bytes(name[:8], "little", signed=True)


def prefix_size(n: int, share: int = SHARE) -> int:
    return n - (share * n + 99) // 100 + 1 if n else 0


def _survey(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: (key, doc_id, n, digest, node, bits) of every text, (token, seen) of tokens seen more than once in a task."""

    def task(batches):
        import pandas as pd

        shingles, held, size = Shingler(), [], 0

        def counts():
            token, seen = np.unique(np.concatenate(held), return_counts=True)
            often = seen > 2
            return pd.DataFrame({"key": None, "doc_id": None, "n": None, "digest": None, "node": None, "bits": None, "token": token[often].view(np.int64), "seen": seen[often]})

        for batch in batches:
            rows = []
            for key, number, text in zip(batch["key"], batch["doc_id"], batch["text"], strict=True):
                tokens = shingles(text)
                bits = bitmap(tokens, words_for(len(tokens), BUCKET_WORDS)).tobytes() if len(tokens) else b""
                name = digest(tokens)
                rows.append((key, number, len(tokens), name, _node(name), bits, None, None))
                held.append(tokens)
                size += len(tokens)
                if size >= COUNTED:
                    yield counts()
                    held, size = [], 0
            yield pd.DataFrame(rows, columns=["key", "doc_id", "n", "digest", "node", "bits", "token", "seen"])
        if held:
            yield counts()

    return docs.mapInPandas(task, "key string, doc_id long, n long, digest binary, node long, bits binary, token long, seen long")


def _prefixes(docs: DataFrame, frequent: np.ndarray, share: int) -> DataFrame:
    """(token, salt, node) of every prefix token; node: 64 bits of the set's digest; salt: -1 unless the token is frequent."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def task(batches):
        import pandas as pd

        shingles, often = Shingler(), sent.value
        for batch in batches:
            token, salt, node = [], [], []
            for text in batch["text"]:
                tokens = shingles(text)
                if not len(tokens):
                    continue
                number = _node(digest(tokens))
                late = np.zeros(len(tokens), np.bool_)
                if len(often):
                    late = often[np.minimum(np.searchsorted(often, tokens), len(often) - 1)] == tokens
                head = np.concatenate([tokens[~late], tokens[late]])[: prefix_size(len(tokens), share)]
                token.append(head)
                salt.append(np.where(np.arange(len(head)) < (~late).sum(), -1, number % SALTS))
                node.append(np.full(len(head), number))
            if token:
                yield pd.DataFrame({"token": np.concatenate(token).view(np.int64), "salt": np.concatenate(salt), "node": np.concatenate(node)})

    return docs.mapInPandas(task, "token long, salt int, node long")


def _groups_of(batches, key: str) -> Iterator[dict[str, np.ndarray]]:
    """Consecutive rows with an equal key, as arrays by column; rows come sorted by it."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        columns = {name: batch[name].to_numpy() for name in batch}
        if held:
            columns = {name: np.concatenate([held[name], values]) for name, values in columns.items()}
        if not len(columns[key]):
            continue
        cuts = np.flatnonzero(columns[key][1:] != columns[key][:-1]) + 1
        ends = [0, *cuts.tolist()]
        for start, end in zip(ends, ends[1:], strict=False):
            yield {name: values[start:end] for name, values in columns.items()}
        held = {name: values[ends[-1] :] for name, values in columns.items()}
    if held:
        yield held


def _pair_may_link(bits: list[np.ndarray], sizes: np.ndarray, share: int) -> bool:
    """The test of two leaves."""
    if not may_link(sizes[0], sizes[1], share):
        return False
    words = min(len(bits[0]), len(bits[1]))
    first, second = fold(bits[0], words), fold(bits[1], words)
    most = int(np.bitwise_count(first & second).sum())
    most += min(int(n) - int(np.bitwise_count(x).sum()) for n, x in zip(sizes, (first, second), strict=True))
    return most >= needed(int(sizes[0]), int(sizes[1]), share)


def _bucket_edges(members: DataFrame, share: int) -> DataFrame:
    """(a, b): for each bucket, edges that connect members whose bitmaps allow a link."""

    def task(batches):
        import pandas as pd

        a, b = [], []
        for rows in _groups_of(batches, "bucket"):
            node, sizes = rows["node"], rows["n"]
            groups = Groups(len(node))
            bits = [np.frombuffer(x, np.uint64) for x in rows["bits"]]
            if len(node) > MOST_MEMBERS:
                groups.label[:] = 0
            elif len(node) == 2:
                groups.label[1] = 0 if _pair_may_link(bits, sizes, share) else 1
            else:
                group_by_bitmaps(bits, sizes, node, share, groups)
            other = groups.label != np.arange(len(node))
            if other.any():
                a.append(node[other])
                b.append(node[groups.label[other]])
            if len(a) >= 2000:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
                a, b = [], []
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return members.repartition("bucket").sortWithinPartitions("bucket", "node").mapInPandas(task, "a long, b long")


def _candidate_components(prefixes: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(node, component) over edges that hold every link; nodes without an edge are left out."""
    bucket = Window.partitionBy("token", "salt")
    mix = F.xxhash64("node", F.lit(7))
    met = prefixes.select(
        "token", "salt", "node",
        F.min("node").over(bucket).alias("least"), F.max("node").over(bucket).alias("most"),
        F.bit_xor("node").over(bucket).alias("xor"), F.bit_xor(mix).over(bucket).alias("mixed"),
    )
    shared = met.filter("least < most or salt >= 0")
    # buckets of equal members are one: members are told by ends and two sums
    kept = shared.select(
        F.when(F.col("salt") < 0, F.xxhash64("least", "most", "xor", "mixed")).otherwise(F.col("token")).alias("bucket"),
        "node",
        F.when(F.col("salt") >= 0, F.col("least")).alias("least"),
    )
    kept = written(kept.distinct(), "buckets")
    nodes = sets.select("node", "n", "bits").dropDuplicates(["node"])
    compared = kept.filter("least is null").select("bucket", "node").join(nodes, "node")
    salted = kept.filter("least is not null")
    near = salted.select(F.col("node").alias("a"), F.col("least").alias("b")).filter("a <> b")
    tops = salted.select("bucket", "least").distinct()
    far = tops.select(F.col("least").alias("a"), F.min("least").over(Window.partitionBy("bucket")).alias("b")).filter("a <> b")
    return components(_bucket_edges(compared, share).unionByName(near).unionByName(far))


def _links(placed: DataFrame, share: int) -> DataFrame:
    """(a, b) digests: checked links that connect each block or pair of blocks; placed: (place, text)."""

    def task(batches):
        import pandas as pd

        shingles = Shingler()
        for rows in _groups_of(batches, "place"):
            found = {}
            for text in rows["text"]:
                tokens = shingles(text)
                found.setdefault(digest(tokens), tokens)
            names, sets = list(found), list(found.values())
            sizes = np.array([len(s) for s in sets])
            groups = Groups(len(sets))

            def linked(a: int, b: int, sets=sets) -> bool:
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                return 100 * common >= share * (len(sets[a]) + len(sets[b]) - common)

            group_by_bitmaps([bitmap(s, words_for(len(s))) for s in sets], sizes, np.array([s[0] for s in sets]), share, groups, linked)
            other = np.flatnonzero(groups.label != np.arange(len(sets)))
            yield pd.DataFrame({"a": [names[k] for k in other], "b": [names[groups.label[k]] for k in other]})

    return placed.repartition("place").sortWithinPartitions("place").mapInPandas(task, "a binary, b binary")


def _place(texts: DataFrame, share: int, block: int) -> DataFrame:
    """(place, text): texts of a component at one place, or, beyond the weight, at each pair of blocks they belong to.

    Blocks are cut by size band, then by hash. Sizes that can link lie in equal or neighbouring bands.
    """
    texts = texts.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / share))).cast("long"))
    weights = texts.groupBy("component", "band").agg(F.sum("n").alias("weight"))
    large = weights.groupBy("component").agg(F.sum("weight").alias("whole")).filter(F.col("whole") > block).select("component")
    small = texts.join(large, "component", "left_anti").select(F.concat_ws("/", "component").alias("place"), "text")
    counts = weights.join(large, "component").select("component", "band", F.ceil(F.col("weight") / block).alias("blocks"))
    cut = texts.join(counts, ["component", "band"]).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")))
    up = counts.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    down = counts.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    cut = cut.join(up, ["component", "band"], "left").join(down, ["component", "band"], "left")
    pair = "concat_ws('/', component, {0}, {1}, {2}, {3})"
    places = F.expr(f"""array_distinct(concat(
        transform(sequence(0L, blocks - 1), x -> {pair.format('band', 'least(x, block)', 'band', 'greatest(x, block)')}),
        if(above is null, array(), transform(sequence(0L, above - 1), x -> {pair.format('band', 'block', 'band + 1', 'x')})),
        if(below is null, array(), transform(sequence(0L, below - 1), x -> {pair.format('band - 1', 'x', 'band', 'block')}))))""")
    return small.union(cut.select(F.explode(places).alias("place"), "text"))


def link_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """(key, doc_id, n_shingles, component_id, first): one row per row of df.

    component_id is the least id reachable by links; first is true for one row of each class, the one
    of the least (id, key), and for the rows of empty texts.
    """
    docs = df.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    survey = written(_survey(docs), "shingles")
    seen = survey.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= frequent)
    often = seen.orderBy(F.desc("seen"), "token").limit(MOST_FREQUENT).select("token").toPandas()["token"].to_numpy(np.int64)
    sets = survey.filter("n > 0").select("key", "doc_id", "n", "digest", "node", "bits")
    classes = sets.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("one"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("node").alias("node"))
    near = _candidate_components(_prefixes(docs.select("text"), np.sort(often.view(np.uint64)), share), sets, share)
    chosen = classes.join(near, "node").select("component", "digest", "n", F.col("one.key").alias("key"))
    texts = docs.select("key", "text").join(chosen, "key")
    links = components(_links(_place(texts, share, block), share))
    grouped = classes.join(links.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("one").alias("first_row"))
    by_class = written(grouped.join(least, "component").select("digest", "component_id", "first_row"), "classes")
    rows = survey.filter("n is not null").select("key", "doc_id", F.col("n").alias("n_shingles"), "digest")
    empty = rows.filter("n_shingles = 0").select("key", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    full = rows.filter("n_shingles > 0").join(by_class, "digest")
    is_first = F.col("first_row").eqNullSafe(F.struct("doc_id", "key"))
    return full.select("key", "doc_id", "n_shingles", "component_id", is_first.alias("first")).unionByName(empty)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near copies: of each class the row of least id stays, once if it repeats; texts without words all stay."""
    kept = link_documents(df, id_col, text_col).filter("first").select("key", "n_shingles").groupBy("key").agg(F.max("n_shingles").alias("n_shingles"))
    rows = df.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key")).join(kept, "key")
    once = rows.filter("n_shingles = 0").select("row").union(rows.filter("n_shingles > 0").dropDuplicates(["key"]).select("row"))
    return once.select(*(F.col("row").getField(c).alias(c) for c in df.columns))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document."""
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
