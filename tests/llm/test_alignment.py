import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from talkmill.llm import alignment
from talkmill.llm.pieces import byte_letters

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    tokenizer = Tokenizer.from_file(A_PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer, SentencePieceProcessor(model_file=B_PATH)


def tokens(libraries, text):
    """[(id, bytes)] of both sides for a whole text."""
    a, b = libraries
    letters = byte_letters()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return left, right


def ends(side):
    at, out = 0, []
    for _, raw in side:
        at += len(raw)
        out.append(at)
    return out


def brute(libraries, texts):
    """Every pair of tokens of every group, one by one."""
    groups, links = [], []
    for text in texts:
        left, right = tokens(libraries, text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        found = []
        if b"".join(x for _, x in left) == raw and b"".join(x for _, x in right) == raw:
            edges = sorted(set(ends(left)) & set(ends(right)))
            start = 0
            for edge in edges:
                found.append((
                    [i for (i, _), e in zip(left, ends(left), strict=True) if start < e <= edge],
                    [i for (i, _), e in zip(right, ends(right), strict=True) if start < e <= edge],
                ))
                start = edge
        groups.append(found)
        links.append([(i, j) for x, y in found for i in x for j in y])
    docs = Counter(pair for own in links for pair in set(own))
    most = Counter()
    for (i, _), n in docs.items():
        most[i] = max(most[i], n)
    for found, own in zip(groups, links, strict=True):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)
        yield (
            sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), len(own),
            sum(docs[p] == most[p[0]] for p in own), sum(docs[p] for p in own),
            hashlib.sha256(shown.encode()).hexdigest() if found else "",
        )


def invented():
    rng = random.Random(7)
    blanks = [" ", "  ", "   ", "\n", "\n ", " \n", "\t", " ", "　 ", "\r\n", " \x1f", "\x85 ", ""]
    words = ["it's", "WE'LL", "né", "12½3", "a_b", "--", "über", "日本語", "الس", "😀👍🏽", "'s", "\x00", "<|endoftext|>", "<s>", "<0x41>", "ﬁ", "½", "é", "﻿"]
    texts = [None, "", " ", "  ", "a", " a", "a ", "  a", "a  ", "\n a", "a\n b", "x" * 3000, "aaaa" * 500, "▁", "a▁b", "a ▁ b", "▁▁", "a▁", "🏽" * 50, "\x00", "\t"]
    for n in range(220):
        text = "".join(rng.choice(words + ["".join(rng.choices("abcdehlorst", k=rng.randint(1, 9)))]) + rng.choice(blanks) for _ in range(rng.randint(1, 30)))
        texts.append(text + ("▁ " if n % 40 == 0 else ""))
    return texts + texts[-5:]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_rows_equal_brute_force(spark, libraries):
    texts = invented()
    df = spark.createDataFrame([(2**60 + n, t, "x", 1) for n, t in enumerate(texts)], "doc_id long, text string, row string, n_a int").repartition(4)
    want = dict(enumerate(brute(libraries, texts)))
    for heavy in (alignment.HEAVY, 0, 40):
        got = {r.doc_id - 2**60: tuple(r[c] for c in COLUMNS) for r in alignment.cross_align(df, A_PATH, B_PATH, heavy).collect()}
        assert got == want


def test_parts_and_a_small_cache_change_nothing(libraries, monkeypatch):
    texts = [t for t in invented() if t is not None]
    texts += [" ".join(texts[30:])]
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        aligner = alignment.Aligner(a.read(), b.read())
    plain = list(aligner.documents(texts))
    monkeypatch.setattr(alignment, "TOGETHER", 90)
    monkeypatch.setattr(alignment, "CACHED", 20)
    for one, other in zip(plain, aligner.documents(texts), strict=True):
        assert all((x == y).all() if hasattr(x, "all") else x == y for x, y in zip(one, other, strict=True))


def test_spans_refine_to_byte_ends(libraries):
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        aligner = alignment.Aligner(a.read(), b.read())
    for text in invented():
        if text and "▁" not in text:
            for side, own in zip((aligner.a, aligner.b), tokens(libraries, text), strict=True):
                ids, found = side(" " + text)
                assert ids.tolist() == [i for i, _ in own] and found.tolist() == ends(own)


def test_long_texts_and_empty_tables(spark):
    long = [(1, "letters" * 30_000), (2, "ab cd " * 300_000), (None, "ab cd")]
    df = spark.createDataFrame(long, "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.cross_align(df, A_PATH, B_PATH).collect()}
    small = got[None]
    assert small.n_a == 2 and got[2].n_links >= 600_000 - 2 and got[1].n_groups > 0
    assert alignment.cross_align(df.filter("false"), A_PATH, B_PATH).count() == 0
