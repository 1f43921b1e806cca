import json
import random

from pyspark.sql import functions as F

from brute import deep, flatten
from talkmill.functions.once import with_once
from talkmill.operators import extract as J
from talkmill.plans import jobs
from talkmill.sources.exports import split_files

GOOD = [
    {"chat_messages": [{"text": "The kettle boils."}, {"text": " Pour it, then. "}]},
    {"chat_messages": [{"content": [{"type": "text", "text": "typed"}]}]},
    {"chat_messages": [{"content": ["plain", {"type": "other", "text": "object"}, 7, None, " "]}]},
    {"chat_messages": [{"text": "  ", "content": ["unused"]}, {"text": "after"}]},
    {"chat_messages": [{"text": "", "content": "not a list"}, {"text": 0}, {"text": []}, {}]},
    {"chat_messages": [], "mapping": {"a": {"message": {"content": {"parts": ["unused"]}}}}},
    {"chat_messages": "", "text": "unused"},
    {"chat_messages": [{"content": ['{"text":"a string"}', {"text": '["also"]'}]}]},
    {"mapping": {"b": {"message": {"content": {"parts": ["first"]}}}, "a": {"message": None}}},
    {"mapping": {"z": {"message": {"content": {"parts": ["one"]}}}, "a": {"message": {"content": {"parts": ["two", '{"x":1}']}}}}},
    {"mapping": {"m": {"message": {"content": {"parts": [{"content_type": "audio_transcription", "text": " spoken "}, {"content_type": "image", "text": "no"}, {"content_type": "audio_transcription", "text": ""}]}}}}},
    {"mapping": {"m": {"message": {"content": "scalar"}}, "n": {"message": {}}, "o": {}, "p": {"message": {"content": {"parts": []}}}}},
    {"mapping": {}, "text": "unused"},
    {"text": "direct"},
    {"outer": [{"inner": {"text": "beyond reach", "n": 1}}]},
    {"a": {"b": {"text": "third level"}}},
    {"message": "m", "text": " t ", "content": "c", "z": {"text": '{"text":"string"}'}},
    {"list": [{"text": str(i)} for i in range(30)]},
    {"list": [0] * 20 + [{"text": "item 21"}]},
    {f"k{i}": {"text": str(i)} for i in range(12)} | {"text": "own"},
    {"k": 1, "l": [[{"text": "in a list of lists"}]], "n": None, "b": True},
    {},
]

BAD = {
    '{"chat_messages":null}': J.BAD_MESSAGES,
    '{"chat_messages":[{"text":"a"},5]}': J.BAD_MESSAGES,
    '{"chat_messages":[{"text":5}]}': J.BAD_TEXT,
    '{"chat_messages":[{"content":[{"text":{"a":1}}]}]}': J.BAD_TEXT,
    '{"chat_messages":[{"content":[{"text":"a","text":"b"}]}]}': J.UNREADABLE,
    '{"mapping":[]}': J.BAD_MAPPING,
    '{"mapping":{"a":null}}': J.BAD_MAPPING,
    '{"mapping":{"a":{"message":"text"}}}': J.BAD_MESSAGE,
    '{"mapping":{"a":{"message":{"content":{"parts":null}}}}}': J.BAD_PARTS,
    '{"mapping":{"a":{"message":{"x":1,"x":2}}}}': J.UNREADABLE,
    "[1]": J.NOT_AN_OBJECT,
    '"text"': J.NOT_AN_OBJECT,
    '{"z":{"content":{"text":"a","text":"b"}},"y":{"q":[{"r":1,"r":2}]}}': J.UNREADABLE,
}


def extracted(spark, raw):
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string").repartition(8)
    rows = with_once(df, {"x": J.extract("raw")}).select("i", "x.text", "x.reject").collect()
    return {r["i"]: (r["text"], r["reject"]) for r in rows}


def random_json(rng, depth):
    strings = ["a", " b ", "", "  ", '{"text":"q"}', "æ ø", "[1]"]
    keys = ["text", "content", "message", "x", "y", "z"]
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([*strings, 1, 0, 1.5, True, None])
    if kind < 0.7:
        picked = rng.sample(keys, rng.randint(0, 6))
        return {k: random_json(rng, depth - 1) for k in picked}
    return [random_json(rng, depth - 1) for _ in range(rng.randint(0, 8))]


def random_conversation(rng):
    strings = ["a", " b ", "", " ", '{"text":"q"}', "æ ø"]

    def text():
        return rng.choice([*strings, *strings, None, 0, False, []])

    def item():
        return rng.choice([text(), {"type": "text", "text": text()}, {"text": text(), "z": {"b": 1, "a": 2}}, 3])

    shape = rng.random()
    if shape < 0.35:
        messages = [
            rng.choice([{"text": text()}, {"content": [item() for _ in range(rng.randint(0, 4))]}, {"text": "", "content": [item()]}])
            for _ in range(rng.randint(0, 5))
        ]
        return {"title": "t", "chat_messages": messages}
    if shape < 0.7:
        nodes = {}
        for k in rng.sample("zyxwvutsrq", rng.randint(0, 6)):
            part = {"content_type": rng.choice(["audio_transcription", "image"]), "text": text()}
            content = rng.choice([{"parts": [part, text(), item()]}, {"parts": []}, {}, "s", None])
            nodes[k] = rng.choice([{"message": {"content": content}}, {"message": {"content": content}}, {"message": None}, {}])
        return {"mapping": nodes}
    found = random_json(rng, 5)
    return found if isinstance(found, dict) else {"k": found}


def test_good_shapes(spark):
    got = extracted(spark, [json.dumps(c, ensure_ascii=False) for c in GOOD])
    for i, conv in enumerate(GOOD):
        assert got[i] == (flatten(conv), None), conv


def test_random_shapes_match_brute_force(spark):
    rng = random.Random(3)
    convs = [random_conversation(rng) for _ in range(400)]
    got = extracted(spark, [json.dumps(c, ensure_ascii=False) for c in convs])
    for i, conv in enumerate(convs):
        assert got[i] == (flatten(conv), None), conv


def test_rejects(spark):
    got = extracted(spark, list(BAD))
    assert {raw: got[i] for i, raw in enumerate(BAD)} == {k: (None, v) for k, v in BAD.items()}


def test_last_of_a_repeated_key_counts(spark):
    raw = '{"chat_messages":[{"text":"old"}],"chat_messages":[{"text":"x","text":"new"}]}'
    unknown = '{"text":"a","z":{"text":"deep"},"text":"b","z":{"text":"c"}}'
    nodes = [f'"{k}":{{"message":{{"content":{{"parts":["{v}"]}}}}}}' for k, v in ("b1", "a2", "b3")]
    mapped = '{"mapping":{' + ",".join(nodes) + "}}"
    got = extracted(spark, [raw, unknown, mapped])
    assert [got[i] for i in range(3)] == [("new", None), ("b c", None), ("3 2", None)]


def test_search_depth_and_lists(spark):
    values = [{"text": "t"}, [{"text": "one"}, {"text": "two"}], {}, [], {"a": {"b": {"text": "deep"}}}]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "j string")
    for depth in (1, 2, 3, 4):
        got = [r[0] for r in df.select(J.search_text(F.col("j"), depth)).collect()]
        assert got == [deep(v, depth) for v in values]


def test_files_and_ids(spark):
    files = {
        "a.json": '[{"uuid":"u","title":"t","text":"x"},{"title":"t","text":""},{"id":"i","text":"y"},{"uuid":null,"text":"z"}]',
        "b.json": '{"title":"single","text":"s"}',
        "c.json": '[{"text":"cut"}',
        "d.json": "5",
        "e.json": '[{"text":"a"},"{\\"text\\":\\"string\\"}",null,{"text":"b"}]',
        "f.json": "[]",
        "g.json": '[{"text":"a"}] more',
        "h.json": "",
    }
    df = spark.createDataFrame(list(files.items()), "source_file string, value string")
    rows = split_files(df).cache()
    cli = {(r["source_file"], r["pos"]): r for r in jobs.flatten(rows).collect()}
    ids = {k: r["conversation_id"] for k, r in cli.items() if r["reject"] is None}
    assert ids == {
        ("a.json", 1): "u",
        ("a.json", 2): "t",
        ("a.json", 3): "conv_3_a.json",
        ("a.json", 4): None,
        ("b.json", 1): "single",
        ("e.json", 1): "conv_1_e.json",
        ("e.json", 4): "conv_4_e.json",
    }
    rejects = {k: r["reject"] for k, r in cli.items() if r["reject"]}
    assert rejects == {
        ("c.json", 1): "malformed_json",
        ("e.json", 2): "not_an_object",
        ("e.json", 3): "not_an_object",
        ("g.json", 1): "malformed_json",
        ("h.json", 1): "malformed_json",
    }
    upload = jobs.flatten(rows, variant="upload").filter("reject IS NULL").collect()
    got = {(r["source_file"], r["pos"]): r["conversation_id"] for r in upload}
    assert got[("a.json", 3)] == "i" and got[("a.json", 4)] == "None"
    assert got[("e.json", 4)] == "conv_4"
    clean = jobs.clean_rows(jobs.flatten(rows), None).select("source_file", "text").collect()
    assert sorted(map(tuple, clean)) == [
        ("a.json", "x"), ("a.json", "y"), ("a.json", "z"), ("b.json", "s"), ("e.json", "a"), ("e.json", "b"),
    ]
