import random

from talkmill.llm import line_windows

SCHEMA = "doc_id long, text string, key string, line int"


def brute(rows):
    """rows: distinct (id, text) in order; the texts left, null texts kept."""
    seen, covered = set(), {}
    for number, text in rows:
        lines = (text or "").split("\n")
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if not any(x.strip(" ") for x in window):
                continue
            if window in seen:
                covered.setdefault((number, text), set()).update(range(at, at + 3))
            seen.add(window)
    return {r: r[1] if r not in covered else "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in covered[r]) for r in rows}


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    out = line_windows.dedup_lines(df)
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_random_texts(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "dd"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100 + i, "p\nq\nr\ns\nt") for i in range(30)] + [(200, None), (201, ""), (202, "\n\n\n\n")]
    assert run(spark, rows) == sorted(((k[0], v) for k, v in brute(rows).items()), key=repr)


def test_repeated_rows_null_ids_and_overlap(spark):
    rows = [(None, "a\nb\nc\nd"), (1, "x\nb\nc\nd\ne"), (1, "x\nb\nc\nd\ne"), (2, "z\nz\nz\nz\nz")]
    assert run(spark, rows) == sorted([(None, "a\nb\nc\nd"), (1, "x\ne"), (1, "x\ne"), (2, "z")], key=repr)
    assert run(spark, [(1, "b\nc\nd\nb\nc\nd")]) == [(1, "b\nc\nd")]


def test_empty_table(spark):
    assert line_windows.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    want = brute(rows)
    got = {r.doc_id: r.text for r in line_windows.dedup_lines(df).collect()}
    assert got == {i: want[i, t] for i, t in rows}


def test_many_lines(spark):
    """Two equal texts of 200,000 lines: the first stays, the second goes."""
    text = "\n".join(f"line {n}" for n in range(200_000))
    assert run(spark, [(1, text), (2, text)]) == sorted([(1, text), (2, "")], key=repr)
