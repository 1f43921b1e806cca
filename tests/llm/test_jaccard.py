import random
import re

import numpy as np
import pytest

from talkmill.llm import jaccard, signature_tree

SCHEMA = "doc_id long, text string, node long, component string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label = [label[i] if x == label[j] else x for x in label]
    ids = {}
    for (number, _), x in zip(rows, label, strict=True):
        ids[x] = min(ids.get(x, number), number, key=lambda v: (v is None, v))
    return sorted(((n, len(s), ids[x]) for (n, _), s, x in zip(rows, sets, label, strict=True)), key=repr)


def invented(seed=4, hot=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    common = [word() for _ in range(60)]
    base = [word() for _ in range(80)]
    texts = []
    for _ in range(60):
        own = [word() for _ in range(rng.randint(1, 90))]
        texts.append(own + common[: rng.choice([0, 20, 60])])
        for _ in range(rng.randint(0, 3)):
            copy = list(texts[-1])
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    for _ in range(hot):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(80)] = word()
        texts.append(copy)
    texts += [["a"], ["A"], ["b", "c"], ["x"] * 50, ["x"] * 9, [], []]
    rng.shuffle(texts)
    return [(i * 3 + 1, rng.choice([" ", "\n", " \t "]).join(t)) for i, t in enumerate(texts)] + [(0, None), (5000, "  a\x85b C d\x1ce f"), (5001, "  a\x85b c d\x1ce F")]


@pytest.mark.parametrize("options", [{}, {"frequent": 4, "block": 900}, {"frequent": 3}, {"block": 300}])
def test_classes_against_all_pairs(spark, options):
    rows = invented()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = jaccard.link_documents(df, **options)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute(rows)


def test_large_buckets_stay_right(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_MEMBERS", 3)
    rows = invented(9, 40)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_documents(df).collect()), key=repr) == brute(rows)


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text), (3, text), (3, text), (None, "none"), (8, ""), (8, ""), (9, None), (4, text + " more")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, text), (None, "none"), (8, ""), (8, ""), (9, None)], key=repr)
    assert jaccard.link_documents(df.filter("false")).count() == 0
    assert jaccard.one_of_each(df.filter("false")).count() == 0


def test_tree_finds_every_group():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(150):
        own = rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64)
        sets += [np.unique(own), np.unique(np.concatenate([own[: int(len(own) * rng.uniform(0.7, 1))], rng.integers(0, 2**63, 3, dtype=np.uint64)]))]
    sizes = np.array([len(s) for s in sets])
    groups, want = signature_tree.Groups(len(sets)), signature_tree.Groups(len(sets))
    share = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    bits = [signature_tree.bitmap(s, signature_tree.words_for(len(s))) for s in sets]
    signature_tree.group_by_bitmaps(bits, sizes, np.array([s[0] for s in sets]), 80, groups, share)
    for a in range(len(sets)):
        for b in range(a):
            if share(a, b):
                want.join(a, b)
    assert (groups.label == want.label).all()
    assert len(set(want.label.tolist())) < len(sets)


def test_given_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = jaccard.jaccard_query(spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
