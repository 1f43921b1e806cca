import hashlib

import pytest
from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.operators import categorize as C
from talkmill.operators.metrics import round_1


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "text string").select(*columns).first()


def test_strip_takes_the_29_white_space_characters(spark):
    white = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    assert sorted(T.WHITESPACE) == white and len(white) == 29
    rows = spark.createDataFrame([(f"{w}a{w}b{w}",) for w in white], "text string")
    got = [r[0] for r in rows.select(T.strip("text")).collect()]
    assert got == [f"a{w}b" for w in white]


def test_hash_and_prefix(spark):
    text = "forstå 😀" * 300
    row = one(spark, text, T.text_hash("text"), T.detection_prefix("text"))
    assert row[0] == hashlib.md5(text.encode()).hexdigest()[:16]
    assert row[1] == text[:1000]


@pytest.mark.parametrize(
    ("n", "cli", "upload"),
    [
        (0, None, "simple"),
        (1, "simple", "simple"),
        (100, "simple", "simple"),
        (101, "medium", "medium"),
        (500, "medium", "medium"),
        (501, "complex", "complex"),
    ],
)
def test_complexity_edges(spark, n, cli, upload):
    row = one(
        spark,
        "😀" * n,
        T.char_length("text"),
        T.complexity_cli(T.char_length("text")),
        T.complexity_upload(T.char_length("text")),
    )
    assert tuple(row) == (n, cli, upload)


def test_preview(spark):
    assert one(spark, "x" * 300, T.preview("text"))[0] == "x" * 300
    assert one(spark, "😀" * 301, T.preview("text"))[0] == "😀" * 300 + "…"


def test_interaction_counts(spark):
    text = "Why? What?? FOLLOW UP, followup and addıtional, follow  up, additionally"
    row = one(spark, text, T.question_marks("text"), T.follow_ups("text"))
    assert tuple(row) == (3, 4)


def test_markers(spark):
    rows = [
        ("The audio of our call was kept", True, False),
        ("Typed by hand on a rainy day", False, False),
        ("Jeg har ikke tid, og det er en skam", False, True),
        ("Nobody has time for such chores", False, False),
        ("a voİce in capitals", True, False),
        ("soundtrack, audiobook", False, False),
        ("og og", False, True),
        ("PÅ færd", False, False),
    ]
    df = spark.createDataFrame(rows, "text string, voice boolean, danish boolean")
    got = df.select("text", C.is_voice("text"), C.is_danish("text")).collect()
    assert [tuple(r) for r in got] == rows
    in_scan = C.categorize(df).select("is_voice").collect()
    assert [r[0] for r in in_scan] == [r[1] for r in rows]


def test_rounding_is_pythons(spark):
    values = [a / b for a in range(0, 400, 7) for b in (1, 3, 4, 8, 20, 40)]
    values += [0.05, 0.15, 0.25, 0.35, 0.45, 2.25, 2.35, 99.95, 1234567.85]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(round_1(F.col("x"))).collect()] == [round(v, 1) for v in values]
