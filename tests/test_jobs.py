import hashlib
import json

import pytest
from pyspark.sql import functions as F

from talkmill.functions import language as L
from talkmill.operators import embed as E
from talkmill.operators import explore as X
from talkmill.operators import language_cache as LC
from talkmill.operators import metrics as M
from talkmill.plans import benchmark, jobs
from talkmill.sources import admission as A
from talkmill.sources import tables as S
from talkmill.sources.vectors import VectorStore
from talkmill.streaming.watch import watch_exports

SAMPLE = [
    {"uuid": "c1", "chat_messages": [{"text": "My program stops with an error: please debug the function."}]},
    {"uuid": "c2", "chat_messages": [{"text": "Which recipe can I cook with leeks, and how long do I bake the meal?"}]},
    {"uuid": "c3", "chat_messages": [{"text": "Kan du forklare hvordan det virker? Jeg vil gerne forstå det."}]},
    {"uuid": "c4", "chat_messages": []},
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(SAMPLE), encoding="utf-8")
    (tmp_path / "two.json").write_text('{"title":"t","text":"hvad er \\"det\\"\\nher"}', encoding="utf-8")
    (tmp_path / "bad.json").write_text("[{", encoding="utf-8")
    (tmp_path / "other.txt").write_text("no", encoding="utf-8")
    return tmp_path


def test_ingest_then_categorize(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    result = jobs.run_ingest(spark, str(folder), out)
    clean = {r["conversation_id"]: r for r in result.clean.collect()}
    assert set(clean) == {"c1", "c2", "c3", "t"}
    assert clean["c1"]["language"] == "en" and clean["c3"]["language"] == "da"
    assert [tuple(r) for r in result.rejects.collect()] == [("bad.json", 1, "malformed_json")]
    summary = spark.read.json(f"{out}/summary").first()
    assert summary["total_files_processed"] == 2
    assert (summary["total_conversations"], summary["empty_conversations"]) == (5, 1)
    assert summary["success_rate"] == 80.0 and summary["rejected_conversations"] == 1

    metrics = jobs.run_categorize(spark, f"{out}/clean_csv", f"{out}/cat").first()
    assert metrics["total_conversations"] == 4
    assert metrics["complexity_scores"].asDict() == {"simple": 4, "medium": 0, "complex": 0}
    assert metrics["performance"]["rows"] == 4
    rows = S.read_csv(spark, f"{out}/cat/categorized_csv").collect()
    got = {r["conversation_id"]: (r["main_category"], r["text"]) for r in rows}
    assert got["c1"][0] == "Code Development" and got["c2"][0] == "Cooking/Food"
    assert got["t"][1] == 'hvad er "det"\nher'


def test_lines_and_files_agree(spark, folder, tmp_path):
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "x.jsonl").write_text("\n".join(json.dumps(c) for c in SAMPLE), encoding="utf-8")
    a = jobs.ingest(spark, str(lines), lines=True, detect=False).clean
    b = jobs.ingest(spark, str(folder / "one.json"), detect=False, spread=3).clean
    pick = ["conversation_id", "text", "text_hash"]
    assert sorted(map(tuple, a.select(pick).collect())) == sorted(map(tuple, b.select(pick).collect()))


def test_no_files(spark, tmp_path):
    result = jobs.ingest(spark, str(tmp_path), detect=False)
    assert result.clean.count() == 0
    assert result.summary.first()["total_conversations"] == 0
    empty = jobs.categorize_rows(result.clean)
    assert M.metrics_cli(empty).first()["total_conversations"] == 0
    assert M.metrics_upload(jobs.upload_rows(result.clean)).count() == 0


def test_upload_analysis(spark, folder):
    (folder / "t.csv").write_text('text,language\n"a ""bug"", really",en\nnan,da\n  ,da\nNA,\nfix it,\n', encoding="utf-8")
    paths = [str(folder / n) for n in ("one.json", "bad.json", "t.csv")]
    rows, metrics = jobs.analyze(spark, paths)
    got = {(r["source_file"], r["conversation_id"]): r for r in rows.collect()}
    assert set(got) == {("one.json", c) for c in ("c1", "c2", "c3")} | {("t.csv", "row_0"), ("t.csv", "row_4")}
    assert got[("t.csv", "row_0")]["text_preview"] == 'a "bug", really'
    assert got[("t.csv", "row_4")]["language"] == "nan"
    m = metrics.first()
    assert (m["total_conversations"], m["files_processed"]) == (5, 2)
    lengths = [r["char_length"] for r in got.values()]
    assert m["avg_length"] == round(sum(lengths) / 5, 1)
    with pytest.raises(ValueError, match=A.UNSUPPORTED):
        jobs.analyze(spark, [*paths, str(folder / "other.txt")])


def test_admission_limits(spark):
    def problems(files, **limits):
        df = spark.createDataFrame(files, "name string, bytes bigint")
        return [r["problem"] for r in A.admission(df, **limits).orderBy("name").collect()]

    assert problems([("a.JSON", 5), ("b.csv", 6), ("c.txt", 1)]) == [None, None, A.UNSUPPORTED]
    assert problems([("a.csv", 5), ("b.csv", 6)], max_file_bytes=5) == [None, A.FILE_TOO_LARGE]
    assert problems([("a.csv", 5), ("b.csv", 6)], max_total_bytes=10) == [None, A.TOTAL_TOO_LARGE]
    assert set(problems([(f"{i}.csv", 1) for i in range(100)])) == {A.TOO_MANY}


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('conversation_id,text\n1,"line\nbreak"\n2,\n3,NA\n,None\n4," "\n5, x \n', encoding="utf-8")
    kept = [r["text"] for r in S.csv_for_categorize(spark, str(path)).collect()]
    assert kept == ["line\nbreak", " ", " x "]
    assert S.csv_for_embed(spark, str(path)).count() == 2
    bare = tmp_path / "y.csv"
    bare.write_text("a,b\n1,2\n", encoding="utf-8")
    with pytest.raises(ValueError):
        S.csv_for_categorize(spark, str(bare))
    assert S.upload_csv_rows(spark, str(bare)).count() == 0
    both = S.read_csv(spark, [str(path), str(bare)])
    assert both.count() == 7 and {"text", "a", "b"} <= set(both.columns)


def test_metrics(spark):
    rows = [
        ("Who built it?", "Information/Curiosity", "General Knowledge", False, 3),
        ("The loop never ends", "Code Development", "Content Creation", True, 6),
        ("x" * 200 + " Follow up", "SoMe/Marketing", "Content Creation", False, 5),
        ("", "Other", "Uncategorized", False, 0),
    ]
    df = spark.createDataFrame(rows, "text string, main_category string, subcategory string, is_voice boolean, confidence_score bigint")
    m = M.metrics_cli(df).first()
    assert m["total_conversations"] == 4 and m["avg_length"] == sum(len(r[0]) for r in rows) / 4
    assert m["subcategory_distribution"]["Content Creation"] == 2
    first = M.metrics_cli(df).select(F.map_entries("subcategory_distribution")[0]["key"]).first()
    assert first[0] == "Content Creation"
    assert m["complexity_scores"] == {"simple": 2, "medium": 1, "complex": 0}
    assert (m["interaction_patterns"]["questions"], m["interaction_patterns"]["follow_ups"]) == (1, 1)
    assert (m["confidence_metrics"]["avg_confidence"], m["confidence_metrics"]["high_confidence"]) == (3.5, 1)
    assert m["voice_conversations"] == 1
    bare = M.metrics_cli(df.drop("is_voice", "confidence_score")).first()
    assert bare["voice_conversations"] == 0 and bare["confidence_metrics"]["high_confidence"] == 0
    top = M.top_categories(df, 2).collect()
    assert [r["share_pct"] for r in top] == [25.0, 25.0] and top[0]["main_category"] == "Code Development"


def test_explore(spark):
    rows = [(f"c{i:02}", f"Text {i} PYTHON" if i % 2 else "none", "Other", i % 5, ["simple", "medium", "complex"][i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "conversation_id string, text_preview string, main_category string, confidence_score int, complexity string")
    assert X.search(df, "python").count() == 15 and X.search(df, "C07").count() == 1
    for column in ("confidence_score", "complexity"):
        for descending in (False, True):
            pages, last = [], None
            while True:
                if last is None:
                    got = X.page(df, column, size=7, descending=descending).collect()
                else:
                    got = X.page_after(df, column, last[column], last["conversation_id"], size=7, descending=descending).collect()
                if not got:
                    break
                pages += [r["conversation_id"] for r in got]
                last = got[-1]
            everything = X.sort_rows(df, column, descending=descending).collect()
            assert pages == [r["conversation_id"] for r in everything]
            third = X.page(df, column, number=2, size=7, descending=descending).collect()
            assert [r["conversation_id"] for r in third] == pages[14:21]
    assert X.sort_rows(df, "complexity").first()["complexity"] == "simple"


def test_language(spark, tmp_path):
    texts = ["Good morning, what will you do with the day?", "Vi skal ikke have mere at spise, og det er godt", "Was macht ihr denn heute noch mit der Arbeit?", "123 !?", "", "Добрый день, как дела?", "今天天气很好", "Καλημέρα σας"]
    df = spark.createDataFrame([(t,) for t in texts * 20 + texts[:1] * 200], "text string")
    model = L.sample_model(spark)
    got = dict(map(tuple, df.select("text", L.identify("text", model)).distinct().collect()))
    assert [got[t] for t in texts] == ["en", "da", "de", "unknown", "unknown", "unknown", "unknown", "unknown"]
    store = str(tmp_path / "store")
    for _ in range(2):
        cached = LC.identify_cached(df, model, store)
        assert {tuple(r) for r in cached.select("text", "language").collect()} == set(got.items())
        assert cached.count() == df.count()
    assert spark.read.parquet(store).count() == len(texts)


def flaky_encoder():
    """Fails on every batch of several texts."""

    def make_predict():
        import numpy as np

        def predict(texts):
            if len(texts) > 1:
                raise MemoryError("too large")
            return np.array([[3.0, 4.0 if texts[0] else 0.0]])

        return predict

    return E.Encoder("flaky", 2, make_predict)


def test_embedding(spark, tmp_path):
    rows = [(str(i), f"text number {i % 7}") for i in range(50)] + [("blank", "  "), ("null", None)]
    df = spark.createDataFrame(rows, "conversation_id string, text string")
    flaky = E.embed_texts(E.to_embed(df), flaky_encoder()).collect()
    assert len(flaky) == 50
    assert flaky[0]["embedding"] == pytest.approx([0.6, 0.8])

    store, encoder = str(tmp_path / "store"), E.hashing_encoder(16)
    first = E.embed(df, encoder, store).collect()
    assert VectorStore(spark, store).vectors().count() == 7
    assert len(first) == 50 and {r["model"] for r in first} == {"feature-hashing-16"}
    assert all(sum(x * x for x in r["embedding"]) == pytest.approx(1) for r in first)
    again = E.embed(df, encoder, store)
    assert VectorStore(spark, store).vectors().count() == 7 and VectorStore(spark, store).version == 1
    assert sorted(map(str, again.collect())) == sorted(map(str, first))
    E.embed(df, E.hashing_encoder(8), store).count()
    assert VectorStore(spark, store).vectors().groupBy("model").count().count() == 2


def test_runs_at_the_same_time_keep_each_vector_once(spark, tmp_path):
    def vectors(names, model="m"):
        rows = [(hashlib.sha256(n.encode()).hexdigest(), [1.0, float(ord(n))], model) for n in names]
        return spark.createDataFrame(rows, "text_sha string, embedding array<float>, model string")

    path = str(tmp_path / "store")
    runs = [VectorStore(spark, path) for _ in range(3)]
    runs[0].add(vectors("abc"))
    runs[1].add(vectors("bcd"))
    runs[2].add(vectors("ab"))
    runs[2].add(vectors("e"))
    store = VectorStore(spark, path)
    assert store.version == 3 and len(store.folders) == 3
    assert sorted(r["embedding"][1] for r in store.vectors().collect()) == [float(ord(c)) for c in "abcde"]
    asked = vectors("aexyz").select("text_sha")
    marked = {r["text_sha"]: r["perhaps"] for r in store.perhaps_known(asked, "m").collect()}
    assert [marked[hashlib.sha256(n.encode()).hexdigest()] for n in "aexyz"] == [True, True, False, False, False]
    assert not any(r["perhaps"] for r in store.perhaps_known(asked, "other").collect())
    assert not VectorStore(spark, str(tmp_path / "none")).folders


def test_a_cold_call_reads_no_kept_key(spark, tmp_path):
    store, encoder = str(tmp_path / "store"), E.hashing_encoder(8)
    E.embed(spark.createDataFrame([("1", "one")], "conversation_id string, text string"), encoder, store)
    rows = E.embed(spark.createDataFrame([("2", "two")], "conversation_id string, text string"), encoder, store)
    first = VectorStore(spark, store).folders[0]
    assert first not in rows._jdf.queryExecution().optimizedPlan().toString() + str(rows.inputFiles())
    assert rows.count() == 1


def test_l2_normalise(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(E.l2_normalise("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_embed_job(spark, tmp_path):
    csv = tmp_path / "c.csv"
    csv.write_text("conversation_id,text\na,hello there\nb,\nc,hello there\n", encoding="utf-8")
    out = jobs.run_embed(spark, str(csv), str(tmp_path / "store"), str(tmp_path / "vectors"))
    got = {r["conversation_id"]: r["embedding"] for r in out.collect()}
    assert set(got) == {"a", "c"} and got["a"] == got["c"] and len(got["a"]) == 256


def test_stream_of_exports(spark, folder):
    rows = watch_exports(spark, str(folder))
    q = rows.writeStream.format("memory").queryName("arrived").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("arrived").select("conversation_id", "main_category")
    assert dict(map(tuple, got.collect()))["c1"] == "Code Development"
    assert spark.table("arrived").count() == 4


def test_job_stages(spark, folder, tmp_path):
    stages = benchmark.job_stages(spark, str(folder), str(tmp_path / "bench"), E.hashing_encoder(16))
    report = benchmark.run(stages)
    assert [s["stage"] for s in report["stages"]] == ["ingest", "embed", "categorize"]
    assert [s["rows"] for s in report["stages"]] == [4, 4, 1]


def test_many_uploads_are_one_scan_each(spark, tmp_path):
    def parts(n):
        paths = []
        for i in range(n):
            (tmp_path / f"{n}-{i}.json").write_text(json.dumps(SAMPLE[:2]), encoding="utf-8")
            (tmp_path / f"{n}-{i}.csv").write_text(f"text,note\nrow {i} of many,x\n", encoding="utf-8")
            paths += [str(tmp_path / f"{n}-{i}.json"), str(tmp_path / f"{n}-{i}.csv")]
        rows, metrics = jobs.analyze(spark, paths, limits=False)
        assert metrics.first()["total_conversations"] == 3 * n
        assert rows.filter("source_file like '%.csv'").select("conversation_id").distinct().collect() == [("row_0",)]
        return rows._jdf.queryExecution().optimizedPlan().toString().count("Relation")

    assert parts(2) == parts(12)


def test_broken_and_foreign_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"one"}\n{"text":\n', encoding="utf-8")
    (tmp_path / "readme.txt").write_text("not an export", encoding="utf-8")
    result = jobs.ingest(spark, str(tmp_path), lines=True, detect=False)
    assert [r["text"] for r in result.clean.collect()] == ["one"]
    assert [r["reason"] for r in result.rejects.collect()] == ["malformed_json"]


def test_benchmark(spark):
    report = benchmark.run({"range": lambda: spark.range(1000).withColumn("x", F.col("id") * 2)})
    assert report["stages"][0]["rows"] == 1000
