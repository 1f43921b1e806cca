"""Values beyond the limits of Spark's typed JSON give the same rows as small ones."""

import json
import random

from test_extract import BAD, GOOD, extracted, random_json

from talkmill.operators import extract as J
from talkmill.operators import long_values as L
from talkmill.plans import jobs

OTHER = [
    '{"mapping":{"a":{"message":{"content":{"parts":{}}}},"b":{"message":""}}}',
    '{"mapping":{"a":{"message":{"content":{"parts":"x"}}}}}',
    '{"chat_messages":[null,{"text":"a"}]}',
    '{"chat_messages":{}}',
    '{"chat_messages":[{"text":true}]}',
    "nothing",
    "[1",
    "null",
]


def test_the_reader_follows_the_rules_of_the_expressions(spark):
    rng = random.Random(4)
    raw = [json.dumps(c, ensure_ascii=False) for c in GOOD + [{"r": random_json(rng, 4), "text": "x"} for _ in range(60)]]
    raw += [b for b, reason in BAD.items() if reason != J.UNREADABLE] + OTHER
    read = L._reader(J.RULES)
    native = extracted(spark, raw)
    for i, text in enumerate(raw):
        got = read(text)
        assert (got["text"], got["reject"]) == native[i], text


def test_items_of_a_list():
    assert L._items_of(' [ {"a": 1} , "}" , 7, null ,[1] ] ') == [
        {"raw": '{"a": 1}', "is_object": True},
        {"raw": "}", "is_object": False},
        {"raw": "7", "is_object": False},
        {"raw": None, "is_object": False},
        {"raw": "[1]", "is_object": False},
    ]
    assert L._items_of("[]") == []
    for bad in ("{}", "[1", "[1,]", "[1] 2", "[1 2]", "", "[tru]"):
        assert L._items_of(bad) is None


def test_either_way_gives_the_same_rows(spark, tmp_path, monkeypatch):
    named = [{"uuid": "u"} | GOOD[0], {"title": None} | GOOD[1], {"title": "t", "id": "i"} | GOOD[8], {"id": 5} | GOOD[13], GOOD[14]]
    (tmp_path / "list.json").write_text(json.dumps(named + [7, "x"]), encoding="utf-8")
    (tmp_path / "one.json").write_text(json.dumps(GOOD[2]), encoding="utf-8")
    (tmp_path / "bad.json").write_text("[{", encoding="utf-8")

    def rows(variant):
        found = jobs.flatten(jobs.read_exports(spark, str(tmp_path)), variant=variant).collect()
        return sorted((tuple(r[c] for c in ("source_file", "pos", "conversation_id", "text", "reject")) for r in found), key=str)

    small = {v: rows(v) for v in ("cli", "upload")}
    monkeypatch.setattr(L, "LONG", 3)
    assert {v: rows(v) for v in ("cli", "upload")} == small


def test_a_conversation_beyond_the_limit_of_a_variant(spark, tmp_path):
    """One message of 140 MB between small conversations, in a list of one line."""
    words = "many words, } \\\" and [more] " * 5_000_000
    with open(tmp_path / "big.json", "w", encoding="utf-8") as file:
        file.write('[{"uuid":"a","text":"first"},{"uuid":"b","chat_messages":[{"text":"')
        file.write(words)
        file.write('"},{"content":["and the end"]}]},{"uuid":"c","text":"last"}]')
    rows = jobs.ingest(spark, str(tmp_path), detect=False).clean.selectExpr("conversation_id", "pos", "char_length(text) n", "right(text, 20) tail", "text_hash")
    got = {r["conversation_id"]: r for r in rows.collect()}
    text = words.replace('\\"', '"').strip() + " and the end"
    assert sorted((k, r["pos"]) for k, r in got.items()) == [("a", 1), ("b", 2), ("c", 3)]
    assert got["b"]["n"] == len(text) and got["b"]["tail"] == text[-20:]
