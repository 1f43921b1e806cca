"""Each stage against plain code on the stage's own input."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from talkmill.llm import bpe
from test_jaccard import brute as classes
from test_line_windows import brute as without_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first and after every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], SF), "test-" + name.replace(" ", "-")))
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality(spark, stages):
    before, after = dict(texts(stages[0])), dict(texts(stages[1]))
    assert after.items() <= before.items()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i, q in labels.items() if q]
    assert sum(i in after for i in clean) >= 0.97 * len(clean) and len(after) < len(before)


def test_lines(stages):
    before = texts(stages[1])
    assert texts(stages[2]) == sorted((i, t) for (i, _), t in without_lines(before).items())


def test_near_duplicates(stages):
    before = texts(stages[2])
    keep = {i for i, _, c in classes(before) if i == c}
    assert texts(stages[3]) == [r for r in before if r[0] in keep]


def test_decontamination(spark, stages):
    before, after = texts(stages[3]), texts(stages[4])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in t for _, t in after for b in items)
    assert {i for i, t in before if any(b in t for b in items)} <= {i for i, _ in before} - {i for i, _ in after}
    assert len(after) >= len(before) - sum(any(b in t for b in items) for _, t in before) - 3


def test_tokens(stages):
    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, text in texts(stages[4]):
        ids = library.encode_ordinary(text)
        want[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages[5].collect()} == want


def test_run_and_odd_rows(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))
    rows = [(1, None, "x"), (2, "", "x"), (None, "Some quiet words. They end here.", "x"), (3, "a\nb\nc", "y"), (3, "a\nb\nc", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "key"]
        assert docs.filter("doc_id is null").count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs.filter("false"), SF).count() == 0
