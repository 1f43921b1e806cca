import hashlib
import random

import numpy as np
import pytest

from talkmill.llm import order_minhash
from talkmill.llm.order_minhash import OrderMinHash, likeness

SCHEMA = "doc_id long, text string, hash long, packed string"


def slow(text, sketch):
    """The same by plain loops over (k-mer, occurrence) pairs."""
    size = min(sketch.kmer, len(text))
    kmers = [text[i : i + size] for i in range(len(text) - size + 1)] if text else []
    ids = sketch.numbered(text).tolist()
    seen, number = {}, {}
    for kmer, i in zip(kmers, ids, strict=True):
        nth = seen[kmer] = seen.get(kmer, 0) + 1
        assert number.setdefault((kmer, nth), i) == i
    assert len(set(ids)) == len(ids)
    out = []
    for add, times in zip(sketch.add[:, 0].tolist(), sketch.times[:, 0].tolist(), strict=True):
        ranked = []
        for place, i in enumerate(ids):
            v = ((i >> 32) ^ add) * times % 2**32
            ranked.append((v ^ (v >> 15), place))
        out.append(tuple(ids[p] for p in sorted(p for _, p in sorted(ranked)[: sketch.size])))
    return out


def invented(n=40, seed=1):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices("abcdeé😀", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("step", [1 << 16, 7])
def test_tuples_of_least_pairs_in_text_order(monkeypatch, step):
    monkeypatch.setattr(order_minhash, "STEP", step)
    sketch = OrderMinHash()
    for text in ["", "a", "abc", "aaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabc", *invented()]:
        tuples, got = slow(text, sketch), sketch(text)
        for tup, h in zip(tuples, got.tolist(), strict=True):
            x = np.full(1, len(tup) + 1, np.uint64)
            for i in tup:
                x = order_minhash._mixed(x * order_minhash._M + np.uint64(i))
            assert int(x[0]) >> 32 == h


def test_sensitive_to_edits_and_order():
    sketch = OrderMinHash()
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    text = " ".join(words)
    little, much = list(words), list(words)
    little[50] = "zzzzz"
    for k in range(0, 200, 3):
        much[k] = "yyyyy"
    moved = " ".join(words[100:] + words[:100])
    own = sketch(text)
    assert likeness(own, sketch(text)) == 1
    assert likeness(own, sketch(" ".join(little))) > 0.8 > likeness(own, sketch(" ".join(much)))
    assert likeness(own, sketch(moved)) < 0.8  # a MinHash of plain k-mers would see hardly any change
    assert likeness(own, sketch("".join(rng.choices("abcdefgh ", k=1200)))) < 0.1


def expected(rows):
    sketch = OrderMinHash()
    texts = [t or "" for _, t in rows]
    out = []
    for k, (number, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(rows)]
        changed = order_minhash.edited(text, after)
        own, other = sketch(text), sketch(changed)
        out.append((number, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, sketch(after))))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = order_minhash.fingerprint_documents(df).collect()
    return sorted(((r.doc_id, r.n_chars, bytes(r.edited).hex(), bytes(r.fingerprint).hex(), bytes(r.edited_fingerprint).hex(), r.near_edited, r.near_next) for r in got), key=repr)


def test_next_documents(spark):
    rows = [(i * 7 - 20, t) for i, t in enumerate(invented(60, 3))] + [(900, None), (901, ""), (902, "end"), (902, "end")]
    shuffled = list(rows)
    random.Random(2).shuffle(shuffled)
    assert run(spark, shuffled) == expected(rows)


def test_few_documents(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, "one two three four")]) == expected([(3, "one two three four")])
    assert run(spark, [(4, "abcdefgh"), (None, "ijklmnopqrst")]) == expected([(None, "ijklmnopqrst"), (4, "abcdefgh")])


def test_given_texts(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    got = order_minhash.fingerprint_query(spark, "/root/testdata/sf0.001")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == expected(rows)
    assert got.selectExpr("avg(near_edited)").first()[0] > 0.3 + got.selectExpr("avg(near_next)").first()[0]
