"""Large files read by splits: the same rows, whatever the splits, as Python's own readers give for a whole file."""

import csv
import io
import json
import random
import re

import pytest

from talkmill.sources import exports as E
from talkmill.sources import quoted as Q
from talkmill.sources import tables as S


@pytest.fixture(params=[7, 64, 1 << 20])
def splits(spark, request):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    for name in names:
        spark.conf.set(name, str(request.param))
    yield request.param
    for name in names:
        spark.conf.unset(name)


def rows_of(spark, paths):
    rows, names = Q.read_quoted(spark, paths, S._CSV)
    return {(r["__file"], r["__row"]): tuple(r[c] for c in rows.columns[: len(rows.columns) - 3]) for r in rows.collect()}


def field(rng):
    letters = ['"', ",", "\n", "\r\n", "a", "é", "😀", " ", "x" * 30, '""', "1"]
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, 6)))


def test_quoted_fields_with_line_breaks(spark, splits, tmp_path):
    rng = random.Random(splits)
    want = {}
    for n in range(3):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        rows = [[f"{k}", field(rng), field(rng) + "."] for k in range(40)]
        writer.writerow(["id", "text", "more"])
        for row in rows:
            writer.writerow(row)
            if rng.random() < 0.2:
                out.write("\n")
        text = out.getvalue()
        (tmp_path / f"f{n}.csv").write_text(text if n else text.rstrip("\r\n"), encoding="utf-8", newline="")
        want |= {(f"f{n}.csv", k): tuple(v or None for v in row) for k, row in enumerate(rows)}
    assert rows_of(spark, str(tmp_path)) == want


def test_stray_quotes_and_headers_over_lines(spark, splits, tmp_path):
    (tmp_path / "a.csv").write_text('id,"long\nname"\n1,5" disk\n2,"a""b"\n3,"x,\n""y"""\n4,un"quoted" text\n', encoding="utf-8")
    if splits < 20:
        with pytest.raises(ValueError):
            rows_of(spark, str(tmp_path))
        return
    assert rows_of(spark, str(tmp_path)) == {
        ("a.csv", 0): ("1", '5" disk'), ("a.csv", 1): ("2", 'a"b'), ("a.csv", 2): ("3", 'x,\n"y"'), ("a.csv", 3): ("4", 'un"quoted" text'),
    }


def test_files_with_other_columns_are_one_scan(spark, splits, tmp_path):
    (tmp_path / "a.csv").write_text("﻿text,language\n\"one\ntwo\",en\n,da\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("conversation_id,text\n7,three\n,four\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("other\nx\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text("", encoding="utf-8")
    rows = S.upload_csv_rows(spark, str(tmp_path))
    got = {(r["source_file"], r["conversation_id"], r["text"], r["language"]) for r in rows.collect()}
    assert got == {("a.csv", "row_0", "one\ntwo", "en"), ("b.csv", "7", "three", "unknown"), ("b.csv", "nan", "four", "unknown")}


def test_an_unclosed_quote_is_kept(spark, splits, tmp_path):
    (tmp_path / "a.csv").write_text('a\n1\n"open\nend\n\nlast', encoding="utf-8")
    assert rows_of(spark, str(tmp_path)) == {("a.csv", 0): ("1",), ("a.csv", 1): ("open\nend\n\nlast",)}


def test_line_effects_agree_with_a_state_machine():
    import pyarrow as pa

    def machine(line, inside):
        state = "in" if inside else "start"
        for c in line:
            if state == "start":
                state = "in" if c == '"' else "start" if c == "," else "plain"
            elif state == "plain":
                state = "start" if c == "," else "plain"
            elif state == "in":
                state = "quote" if c == '"' else "in"
            elif c == '"':
                state = "in"
            else:
                state = "start" if c == "," else "plain"
        return state == "in"

    rng = random.Random(1)
    lines = ["".join(rng.choice('",ab ') for _ in range(rng.randint(0, 9))) for _ in range(5000)]
    effects, after, _ = Q._states()
    outside, inside = effects(pa.array(lines))
    assert outside.tolist() == [machine(x, False) for x in lines]
    assert inside.tolist() == [machine(x, True) for x in lines]
    for begin in (False, True):
        state, want = begin, []
        for x in lines:
            state = machine(x, state)
            want.append(state)
        assert after(outside, inside, begin).tolist() == want


def value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 3 else 4)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", "}", "{", "[", "]", ",", "é", "😀", "\n", "a", "\\\\"]) for _ in range(rng.randint(0, 8)))
    if kind < 5:
        return rng.choice([None, True, 1.5, -7])
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{k}": value(rng, depth + 1) for k in range(rng.randint(0, 3))}


def test_lists_of_json(spark, splits, tmp_path):
    rng = random.Random(splits)
    want = {}
    for n in range(12):
        items = [value(rng, 0) if rng.random() < 0.3 else {"a": value(rng), "b": value(rng)} for _ in range(rng.randint(0, 12))]
        text = json.dumps(items, indent=rng.choice([None, None, 2]), ensure_ascii=rng.random() < 0.5)
        (tmp_path / f"f{n}.json").write_text(("﻿" if n == 3 else "") + text + rng.choice(["", "\n", " \n"]), encoding="utf-8")
        want |= {(f"f{n}.json", k + 1): item for k, item in enumerate(items)}
    got = {}
    for r in E.read_exports(spark, str(tmp_path)).collect():
        raw, expected = r["conversation"], want[r["source_file"], r["pos"]]
        assert expected is None or (r["reject"] is None) == isinstance(expected, dict)
        got[r["source_file"], r["pos"]] = expected if raw is None and expected is None else raw if isinstance(expected, str) else json.loads(raw)
    assert got == want


def test_other_values_and_broken_files(spark, splits, tmp_path):
    files = {
        "object": ('{"a": "}", "b": [{"c": 1}, {"d": {}}]}', [None]),
        "object_line": ('{"a": 1}\n', [None]),
        "number": ("7", []),
        "text": ('"}{"', []),
        "empty_list": (" [ ] ", []),
        "cut": ('[{"a": 1}, {"b": 2}', [E.MALFORMED]),
        "cut_string": ('[{"a": 1}, {"b": "', [E.MALFORMED]),
        "cut_after": ('[{"a": 1},', [E.MALFORMED]),
        "cut_object": ('{"a": {"b": 1}', [E.MALFORMED]),
        "twice": ("[{}] [{}]", [E.MALFORMED]),
        "two_objects": ("{} {}", [E.MALFORMED]),
        "word": ("nothing", [E.MALFORMED]),
        "blank": (" \n", [E.MALFORMED]),
        "nothing": ("", [E.MALFORMED]),
        "no_comma": ('[{"a": 1} {"b": 2}]', [None, E.MALFORMED]),
        "comma_last": ('[{"a": 1},]', [None, E.MALFORMED]),
        "bad_inside": ('[{"a": 1}, {"b": tru}, 7, {"c": 3}]', [None, E.MALFORMED, E.NOT_AN_OBJECT, None]),
    }
    for name, (text, _) in files.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    got = {}
    for r in sorted(E.read_exports(spark, str(tmp_path)).collect(), key=lambda r: r["pos"]):
        got.setdefault(r["source_file"].removesuffix(".json"), []).append(r["reject"])
    assert got == {name: want for name, (_, want) in files.items() if want}


def test_a_large_list_and_a_large_table_are_many_tasks(spark, tmp_path):
    items = [{"uuid": f"c{k}", "chat_messages": [{"text": f"line {k} }} \\ \"quoted\"\n{'x' * (k % 50)}"}]} for k in range(20_000)]
    (tmp_path / "one.json").write_text(json.dumps(items), encoding="utf-8")
    with open(tmp_path / "one.csv", "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(["text"])
        writer.writerows([[f"{k}\n{'y' * (k % 40)}"] for k in range(20_000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        rows = E.read_exports(spark, str(tmp_path / "one.json"))
        assert rows.rdd.getNumPartitions() > 8
        got = {r["pos"]: json.loads(r["conversation"]) for r in rows.collect()}
        assert got == dict(enumerate(items, 1))
        table = S.upload_csv_rows(spark, str(tmp_path / "one.csv"))
        assert table.rdd.getNumPartitions() > 5
        assert {r["conversation_id"]: r["text"] for r in table.collect()} == {f"row_{k}": f"{k}\n{'y' * (k % 40)}" for k in range(20_000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_read_of_csv_by_spark_gives_the_same(spark, tmp_path):
    folder = str(tmp_path / "out")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) as id", "text", "lang")
    S.write_csv(docs, folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sorted(map(tuple, S.read_csv(spark, folder).select("id", "text", "lang").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plain = spark.read.options(**S._CSV, header=True, multiLine=True).csv(folder)
    assert got == sorted(map(tuple, plain.collect())) == sorted(map(tuple, docs.collect()))
    assert not any(re.search("\r", r[1]) for r in got)
