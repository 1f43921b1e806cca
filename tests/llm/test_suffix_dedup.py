import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from talkmill.llm import suffix_dedup
from talkmill.llm.deep_shallow import common_prefix, sort_strings

SCHEMA = "doc_id long, text string, packed int, spans string"


def brute(rows, length=400):
    """(id, bytes, removed, runs, digest) of each row, by counting every string."""
    datas = [(t or "").encode() for _, t in rows]
    seen = Counter(d[k : k + length] for d in datas for k in range(len(d) - length + 1))
    out = []
    for (number, _), d in zip(rows, datas, strict=True):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((number, len(d), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).digest()))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = suffix_dedup.drop_repeated_bytes(df, keep_text=False, **options)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=repr)


def invented(seed=2, hot=30):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choices("abcdefgh éñ", k=n))
    passage, long = prose(900), prose(3000)
    texts = [prose(rng.randint(0, 1500)) for _ in range(30)]
    texts += [prose(rng.randint(0, 700)) + passage + prose(rng.randint(0, 700)) for _ in range(hot)]
    for _ in range(hot):
        copy = list(long)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = "Z"
        texts.append("".join(copy))
    texts += [long, long, "a" * 1200, "ab" * 450, "ab" * 450 + "c", "x" + "ab" * 300, prose(399), prose(50) * 30]
    own = prose(500)
    texts += [own + prose(300) + own, passage[:399], passage[:400], passage[100:620]]
    rng.shuffle(texts)
    return [(i * 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("most", [2048, 4])
def test_against_all_strings(spark, most):
    rows = invented() + [(900, None), (901, "")]
    assert run(spark, rows, most=most) == brute(rows)


def test_short_strings_and_many_texts(spark):
    rng = random.Random(6)
    parts = ["".join(rng.choices("ab", k=rng.randint(60, 160))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    for most in (2048, 3):
        assert run(spark, rows, length=128, most=most) == brute(rows, 128)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(1).choices("abcdefghij", k=600))
    rows = [(1, text), (1, text), (None, text + "y"), (1, "other"), (2, text[:300])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    kept = suffix_dedup.drop_repeated_bytes(spark.createDataFrame([(1, "q" + text), (2, text)], "doc_id long, text string"))
    assert {(r.doc_id, bytes(r.kept)) for r in kept.collect()} == {(1, b"q"), (2, b"")}


@pytest.mark.parametrize("most", [2048, 1])
def test_shared_anchors_without_repeated_strings(spark, most):
    """Texts that share 330 bytes have an anchor in common and nothing to remove: a task may find no ranges at all."""
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = prose(330)
    rows = [(1, prose(200) + shared + prose(200)), (2, prose(300) + shared + prose(100))]
    assert run(spark, rows, most=most) == brute(rows)
    assert {r[2] for r in brute(rows)} == {0}


def test_last_ranges_of_a_task_fill_a_frame():
    """A task whose last group fills a frame has none left; every frame has rows, as empty lists have no type."""
    text = bytes(random.Random(8).choices(b"abcdefgh", k=700))

    class Groups:
        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, *_):  # noqa: N802
            return self

        def mapInPandas(self, task, schema):  # noqa: N802
            batch = pd.DataFrame({"core": range(5001), "name": [str(k).encode() for k in range(5001)], "context": [text] * 5001, "anchor": 300, "copies": 2})
            return list(task([batch]))

    assert [len(frame) for frame in suffix_dedup._judge(Groups(), 400)] == [5001]


def test_a_repeated_word_has_few_rows():
    """Equal contexts close together in a text are one row, and every start is still in one of them."""
    for text in (b"The " * 5000, b"x" * 3000, b"The " * 900 + bytes(random.Random(9).choices(b"abcdef", k=900)) + b"The " * 900):
        gram, place, first, last = (x.tolist() for x in suffix_dedup.anchors(np.frombuffer(text, np.uint8)))
        rows = suffix_dedup.named_anchors(text)
        assert sum(rows["times"]) == len(gram) > 5 * len(rows["gram"])
        covered = np.zeros(len(text), bool)
        for a, far, width in zip(rows["first"], rows["far"], rows["width"], strict=True):
            covered[a : far + width + 400] = True
        assert covered.all()


def test_repeated_words_against_all_strings(spark):
    rng = random.Random(10)
    prose = lambda n: "".join(rng.choices("abcdefgh éñ", k=n))
    texts = [prose(rng.randint(0, 300)) + word * rng.randint(90, 700) + prose(rng.randint(0, 600)) + word * rng.randint(1, 300) for word in ("The ", "La ", "é", "abcdefghijk ") for _ in range(4)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (99, texts[1])]
    for most in (2048, 3):
        assert run(spark, rows, most=most) == brute(rows)


def test_chunks_of_long_texts(monkeypatch):
    data = np.frombuffer("".join(random.Random(4).choices("abcd", k=9000)).encode(), np.uint8)
    whole = suffix_dedup.anchors(data)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    parts = suffix_dedup.anchors(data)
    at = lambda found: [(h, p) for h, p, a, b in zip(*map(np.ndarray.tolist, found), strict=True) for _ in range(a, b + 1)]
    assert at(whole) == at(parts) and len(at(whole)) == 9000 - 399


def test_deep_shallow_order():
    rng = random.Random(7)
    for shallow in (0, 1, 3, 24):
        strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 40))) for _ in range(200)]
        strings += [b"ab" * 20 + bytes(rng.choices(b"xyz", k=3)) for _ in range(50)]
        order, prefix = sort_strings(strings, 0, shallow)
        assert [strings[k] for k in order] == sorted(strings)
        assert sorted(order.tolist()) == list(range(len(strings)))
        for k in range(1, len(order)):
            assert prefix[k] == common_prefix(strings[order[k - 1]], strings[order[k]])


def test_given_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = suffix_dedup.suffix_query(spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((*r[:4], r[4].hex()) for r in brute(rows)), key=repr)
