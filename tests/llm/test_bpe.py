import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
import tiktoken

from talkmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def invented():
    rng = random.Random(5)
    blanks = [" ", "  ", "   ", "\n", "\n ", " \n", "\t", " ", "　 ", "  ", "\r\n", " \x1f", "\x85 "]
    words = ["it's", "WE'LL", "né", "12½3", "a_b", "--", "!?", "über", "日本語", "الس", "😀👍🏽", "x'", "'s", "\x00", "�", "é"]
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "\n\n", "aaaa" * 30, "ab" * 500, "aab" * 301, "<|endoftext|>"]
    for _ in range(300):
        texts.append("".join(rng.choice(words + ["".join(rng.choices("abcdehlorst", k=rng.randint(1, 9)))]) + rng.choice(blanks) for _ in range(rng.randint(1, 30))))
    texts.append("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3000)))
    texts.append("".join(rng.choices("eéèaàuü", k=2000)))
    return texts


def test_same_ids_as_the_library_and_round_trip(ranks, library):
    texts = invented()
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    ids = codec.encode(texts)
    for text, got in zip(texts, ids, strict=True):
        want = library.encode_ordinary(text)
        assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == want, repr(text[:80])
    assert codec.decode(ids) == [text.encode() for text in texts]


def test_full_caches_change_nothing(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 20)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    texts = invented()[:60]
    assert [codec.encode([text])[0] for text in texts] == bpe.Codec(ranks, public_tokenizers.PATTERN).encode(texts)


def test_query_rows(spark, library):
    rows = [(1, "one two", "x"), (2, None, "x"), (3, "", "x"), (None, "four", "x"), (1, "one two", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    got = sorted(map(tuple, bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()), key=repr)

    def want(number, text):
        ids = library.encode_ordinary(text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        return number, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert got == sorted((want(n, t) for n, t, _ in rows), key=repr)
    assert bpe.digests(df.filter("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_given_texts(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in bpe.encode_decode(df, PATH, public_tokenizers.PATTERN).collect():
        assert bytes(r.decoded).decode() == texts[r.doc_id]
        raw = bytes(r.ids)
        assert [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)] == library.encode_ordinary(texts[r.doc_id])


def test_memory_does_not_grow_with_the_texts_of_a_batch(ranks):
    """Four times the texts, of words that are known already, hold little more at a time."""
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    words = [f"{a}{b}" for a in ("water", "stone", "light", "over") for b in range(200)]
    text = " ".join(words[(i * i) % len(words)] for i in range(3000))
    codec.decode(codec.encode([text]))
    peaks = []
    for many in (60, 240):
        texts = [text] * many
        tracemalloc.start()
        for part in bpe.blocks(texts):
            assert len(codec.decode(codec.encode(texts[part]))) == len(texts[part])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert sum(map(len, texts)) > 4_000_000 and peaks[1] < 1.5 * peaks[0]


def test_words_of_pieces_end_to_end(ranks):
    """Words of all pieces are one list with borders, no list for each piece; ids with gaps select their own letters."""
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    given = [" one", " two,", "\n x", " three-four", "a "]
    pieces, words, edges = codec.split(given)
    assert sorted(pieces) == sorted(given) and len(edges) == len(pieces) + 1
    assert all("".join(words[a:z]) == piece for piece, a, z in zip(pieces, edges, edges[1:], strict=False))
    gaps = bpe.Codec({bytes([b]): 3 * b + 7 for b in range(256)}, public_tokenizers.PATTERN)
    ids = gaps.encode(["a b", "", "ü"])
    assert ids[0] == b"".join((3 * b + 7).to_bytes(4, "little") for b in b"a b")
    assert gaps.decode(ids) == [b"a b", b"", "ü".encode()]
