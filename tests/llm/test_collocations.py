import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from talkmill.llm import collocations as C


def brute(rows, least, subsumed, top):
    """All phrases counted by their places; every phrase compared with every longer one."""
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                count[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, seen in count.items():
        candidates = {p: f for p, f in seen.items() if " " in p and f >= least}
        scored = []
        for phrase, a in candidates.items():
            if any(f" {phrase} " in f" {q} " and 100 * f >= subsumed * a for q, f in candidates.items() if q != phrase):
                continue
            words, cuts = phrase.split(" "), []
            for k in range(1, len(words)):
                left, right = seen[" ".join(words[:k])], seen[" ".join(words[k:])]
                cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            scored.append((-score, -a, phrase.encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def invented(count=250, seed=1):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "état", "日本", "a\x1cb", "don't", "x" * 300, "a", "b"]
    phrases = ["new york city", "the state of", "a b a b a", "one two three four five six", "état of the art"]
    for _ in range(count):
        lang = rng.choice(["en", "en", "en", "fr", None, "und"])
        text = "".join((rng.choice(phrases) if rng.random() < 0.5 else rng.choice(words)) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r\n", "!", "\x0b", " ", " "]) for _ in range(rng.randint(0, 40)))
        yield lang, text if rng.random() > 0.02 else None


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("subsumed, top", [(100, 2000), (60, 10)])
def test_same_rows_as_brute_force(spark, subsumed, top):
    rows = list(invented())
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, text string, prefix string").repartition(7)
    want = brute(rows, 8, subsumed, top)
    assert len(want) > 15
    assert found(C.collocations(df, least=8, subsumed=subsumed, top=top)) == want


def test_small_bounds_change_nothing(spark, monkeypatch):
    rows = list(invented(seed=2))
    for name, value in {"BITS": 16, "HOT": 20, "SHARDS": 3, "ROWS": 40, "WORDS": 9, "BLOCK": 30}.items():
        monkeypatch.setattr(C, name, value)
    monkeypatch.setattr(C.blocks, "__defaults__", (30,))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert found(C.collocations(df, least=6)) == brute(rows, 6, 100, 2000)


def test_edges(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert found(C.collocations(empty)) == []
    none = spark.createDataFrame([(None, None), ("en", ""), ("en", " \t. ")], "lang string, text string")
    assert found(C.collocations(none, least=1)) == []
    long = [("en", "word " * 200_000), ("en", "b" * 1_000_000)]
    got = found(C.collocations(spark.createDataFrame(long, "lang string, text string")))
    assert got == brute(long, 100, 100, 2000) and len(got) == 4


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13, 10**14)], "a long, n long")
    expr = "cast(cast(1000 as decimal(4, 0)) * (cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(a as decimal(19, 0)) * cast(a as decimal(19, 0))) as bigint)"
    assert df.selectExpr(expr).first()[0] == 1000 * 10**27 // 10**26


def test_words_of_a_block():
    data = "one  two\n\nthree étât\x00 one \n one".encode() + b" " + b"x" * 5000
    starts, ends, piece, hashes = C.Hasher()(data)
    words = [data[a:b].decode() for a, b in zip(starts, ends, strict=True)]
    assert words == ["one", "two", "three", "étât\x00", "one", "one", "x" * 5000]
    assert piece.tolist() == [0, 0, 2, 2, 2, 3, 3]
    assert hashes[0] == hashes[4] == hashes[5] and len(set(hashes.tolist())) == 5
    again = C.Hasher()(b"a longer start " + data)[3]
    assert again[3:].tolist() == hashes.tolist()


def test_hashes_have_no_collisions():
    words = ["".join(p) for k in range(1, 5) for p in itertools.product("abcdefgh\x00é", repeat=k)]
    assert len(set(C.Hasher()(" ".join(words).encode())[3].tolist())) == len(words)


def test_bits(spark):
    phrases = ["a b", "two words", "état 日本"]
    df = spark.createDataFrame([("en", p, 10**6 * (k > 0)) for k, p in enumerate(phrases)], "lang string, phrase string, f long")
    known = C.Known(C._bitmap(df, 2))
    hashes = C.Hasher()("\n".join(phrases).encode())[3]
    mine, other = (C.phrase_hashes(hashes, 2, C.language_hash(x))[::2] for x in ("en", "fr"))
    assert known.frequent(mine).all() and known.hot(mine).tolist() == [False, True, True]
    assert not known.frequent(other).any() and not known.hot(other).any()
    assert C._bitmap(df.filter(F.lit(False)), 2) is None
