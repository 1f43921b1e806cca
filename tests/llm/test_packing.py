import json
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from talkmill.llm import packing, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def strange(rng, count=200):
    blanks = [" ", "  ", "   ", "\n", "\n ", " \n", "\t", " ", "　 ", "\r\n", " \x1f", "\x85 ", " ▁", "▁ ", ""]
    words = ["it's", "WE'LL", "né", "12½3", "a_b", "--", "über", "日本語", "😀👍🏽", "'s", "\x00", "<|endoftext|>", "<s>", "<0x41>", "ﬁ"]
    for _ in range(count):
        yield "".join(rng.choice(words + ["".join(rng.choices("abcdehlorst", k=rng.randint(1, 9)))]) + rng.choice(blanks) for _ in range(rng.randint(1, 30)))


EDGES = ["", " ", "  ", "a", " a", "a ", "  a", "a  ", "\n a", "a\n b", "a \n b", "x" * 5000, " ▁ a", "a\n  b", "<|endoftext|> a <|endoftext|>"]


def test_parts_and_pieces_join_to_the_text():
    for text in [*EDGES, *strange(random.Random(1))]:
        assert "".join(pieces.cut(text)) == text
        assert "".join(pieces.parts(text, 7)) == text
        assert sum(map(pieces.cut, pieces.parts(text, 7)), []) == pieces.cut(text)


@pytest.mark.parametrize("ranked", [True, False])
def test_ids_are_those_of_the_library_on_whole_texts(library, monkeypatch, ranked):
    rng = random.Random(2)
    texts = [*EDGES, *strange(rng), *("".join(rng.choices("aeioürstn'1.,-\n ", k=200)) for _ in range(300))]
    with open(PATH, encoding="utf-8") as file:
        definition = file.read()
    ranks = packing.merge_ranks(definition)
    assert len(ranks) == 50_256
    encoder = packing.Encoder(definition, ranks, public_tokenizers.PATTERN) if ranked else packing.Encoder(definition)
    monkeypatch.setattr(packing, "CACHED", 50)
    for group in (texts, texts[:40], texts[30:]):
        for text, ids in zip(group, encoder(group), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_ranks_are_refused_where_they_would_merge_otherwise():
    letters = {c: n for n, c in enumerate(pieces.byte_letters())}

    def definition(*merges):
        return json.dumps({"model": {"type": "BPE", "vocab": letters | {a + b: 256 + n for n, (a, b) in enumerate(merges)}, "merges": merges}})

    assert packing.merge_ranks(definition(("a", "b"), ("ab", "c")))
    # "abc" itself comes to "ab", "c", which has no merge.
    assert packing.merge_ranks(definition(("a", "b"), ("b", "c"), ("a", "bc"))) is None


def expand(runs):
    """size → [(sequence, offset)] by piece number."""
    found = defaultdict(dict)
    for size, first, number, sequence, times, offset in runs:
        for k in range(number):
            assert first + k not in found[size]
            found[size][first + k] = (sequence + k // times, offset + k % times * size)
    return found


def test_plan_fills_sequences_without_gaps():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([7, 20, 64])
        counts = {s: rng.choice([0, 1, 2, 3, 50]) for s in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        found = expand(packing.plan(counts, capacity))
        held = defaultdict(list)
        for size, number in counts.items():
            assert sorted(found[size]) == list(range(number))
            for sequence, offset in found[size].values():
                held[sequence].append((offset, size))
        for places in held.values():
            at = 0
            for offset, size in sorted(places):
                assert offset == at
                at += size
            assert at <= capacity
            assert sum(3 * size > capacity for _, size in places) <= 2
        assert sorted(held) == list(range(len(held)))


def fewest(sizes, capacity):
    """The least number of sequences, by trying every place of every piece."""
    best = len(sizes)

    def put(at, gaps):
        nonlocal best
        if len(gaps) >= best and at < len(sizes):
            return
        if at == len(sizes):
            best = min(best, len(gaps))
            return
        for k in {gap: k for k, gap in enumerate(gaps) if gap >= sizes[at]}.values():
            put(at + 1, gaps[:k] + [gaps[k] - sizes[at]] + gaps[k + 1 :])
        put(at + 1, gaps + [capacity - sizes[at]])

    put(0, [])
    return best


def test_plan_needs_few_sequences():
    rng = random.Random(4)
    more = 0
    for _ in range(150):
        capacity = 24
        sizes = sorted((rng.choice([rng.randint(1, 24), rng.randint(1, 9)]) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        used = len({sequence for places in expand(packing.plan(counts, capacity)).values() for sequence, _ in places.values()})
        least = fewest(sizes, capacity)
        assert least <= used <= least + 1
        more += used - least
    assert more <= 5


def test_plan_is_small_for_many_pieces():
    rng = random.Random(5)
    runs = packing.plan({s: rng.randint(1, 10**9) for s in range(1, 2049)})
    assert len(runs) < 100_000


def check(rows, texts, library, capacity):
    held, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        cuts = list(packing.cut_document(len(ids), capacity))
        got = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in got] == [(n, a, k) for n, (a, k) in enumerate(cuts)]
        for r in got:
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length]))
    return len(held)


def test_cutting():
    assert list(packing.cut_document(1, 4)) == [(0, 1)]
    assert list(packing.cut_document(4, 4)) == [(0, 4)]
    assert list(packing.cut_document(9, 4)) == [(0, 1), (1, 4), (5, 4)]
    assert list(packing.cut_document(8, 4)) == [(0, 4), (4, 4)]


def test_rows(spark, library):
    texts = dict(enumerate([None, "", "one", "two words here", "long " * 200, "x" * 3000, *strange(random.Random(6), 60)], 2**60))
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()], "doc_id long, text string, task string, nth int").repartition(5)
    used = check(packing.pack(df, PATH, public_tokenizers.PATTERN, 64).collect(), texts, library, 64)
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts.values())
    assert used <= -(-total // 64) + 3
    assert packing.pack(df.filter("false"), PATH).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    rows = packing.pack(twice, PATH).collect()
    assert sorted(r.offset for r in rows) == [0, 3, 6] and len({r.sequence_id for r in rows}) == 1


def test_given_texts_fill_their_sequences(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = packing.packing_query(spark, "/root/testdata/sf0.001").collect()
    used = check(rows, texts, library, packing.CAPACITY)
    assert used <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1
