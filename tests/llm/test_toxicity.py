import itertools
import math

import numpy as np
import pytest

from talkmill.llm import toxicity

SCHEMA = "doc_id long, text string, score double, toxic int"


def slow(emission, transitions):
    """Marginals and expected transitions by all tag sequences."""
    weight, chance, pairs = 0.0, np.zeros(len(emission)), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=len(emission)):
        w = math.exp(sum(e for e, t in zip(emission, tags, strict=True) if t) + sum(transitions[a, b] for a, b in itertools.pairwise(tags)))
        weight += w
        chance += w * np.array(tags)
        for a, b in itertools.pairwise(tags):
            pairs[a, b] += w
    return chance / weight, pairs / weight


@pytest.mark.parametrize("block", [2, 3, 32])
def test_forward_backward_against_all_sequences(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 1, 7, 9, 0, 2, 4])
    emission = rng.normal(0, 2, lengths.sum())
    transitions = rng.normal(0, 1, (2, 2))
    got, pairs = toxicity.marginals(emission, lengths, transitions)
    want, all_pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        if n:
            chance, own = slow(emission[at : at + n], transitions)
            want += chance.tolist()
            all_pairs += own
        at += n
    assert np.allclose(got, want)
    assert np.allclose(pairs, all_pairs)


def test_held_out_accuracy_and_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = toxicity.toxicity_query(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(out) == 1000 and out["score"].between(0, 1).all()
    seen = out.merge(labels, on="doc_id")
    held = seen[seen["held_out"]]
    right = held["predicted"] == held["toxic"]
    assert right.mean() > 0.95
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for doc_id, spans in out[["doc_id", "spans"]].itertuples(index=False):
        for span in filter(None, spans.split(",")):
            a, b = map(int, span.split(":"))
            assert text[doc_id][a:b].split()


def test_odd_rows(spark):
    rows = [(i, "you awful grubbit person" if i % 2 else "a fine calm day of walking", 0.0, 1) for i in range(40)]
    rows += [(100, None, 0.0, 1), (101, "", 0.0, 1), (None, "grubbit", 0.0, 1), (3, rows[3][1], 0.0, 1), (102, "walking " * 30000 + "you awful grubbit person", 0.0, 1)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, SCHEMA)
    got = toxicity.score_toxicity(df, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].score > 0.5 > by[100].score == by[101].score
    assert by[3].spans and by[102].spans.endswith(str(30000 * 8 + 24))
    assert toxicity.score_toxicity(df.filter("false"), labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(df, labels.filter("false")).collect()} == {0.0}


def test_words_without_blanks_all_count(spark):
    """Toxic words behind the first eight of a text without blanks, in training and in scoring."""
    rows = [(i, "you awful grubbit person" if i % 2 else "a fine calm day of walking", 0.0, 1) for i in range(40)]
    calm = ",".join(["walking"] * 40)
    joined = f"{calm},you,awful,grubbit,person"
    rows += [(100, calm, 0.0, 1), (101, joined, 0.0, 1), (102, f"{calm} {joined} {calm}", 0.0, 1)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    by = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert by[101].score > 2 * by[100].score and not by[100].spans
    for doc_id in (101, 102):
        (a, b), = [map(int, span.split(":")) for span in by[doc_id].spans.split(",")]
        assert "grubbit" in rows[40 + doc_id - 100][1][a:b] and b - a < 80


def test_tokens_and_their_places_agree():
    texts = ["", " a  b ", "x/" * 50, "..." * 30, "İ" * 30 + " 1.2.3.4.5.6.7.8.9 short " + "一二，三" * 20, "a-" * 16 + "\x85" + "b:" * 9]
    for text in texts:
        tokens = toxicity.tokens_of(text)
        whole = toxicity._offsets(text, np.ones(len(tokens)))
        a, b = map(int, (whole or "0:0").split(":"))
        assert text[a:b] == text.strip() and "".join(tokens) == "".join(text.lower().split())
        found = [toxicity._offsets(text, np.eye(len(tokens))[k]) for k in range(len(tokens))]
        assert [text[int(a) : int(b)].lower() for a, b in (x.split(":") for x in found)] == tokens
    assert len(toxicity.features(",".join("abcdefghijkl"))) == 3 * 12 + 1
