"""Work that goes on from what earlier runs have kept."""

import json

from pyspark.sql import functions as F

from talkmill.operators import explore as X
from talkmill.operators import metrics as M
from talkmill.plans import jobs
from talkmill.streaming.watch import Arrivals


def test_any_page_is_read_from_its_ranges(spark, tmp_path):
    rows = [(f"c{i:03}", i % 7 if i % 11 else None, ["simple", "medium", "complex"][i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "conversation_id string, confidence_score int, complexity string").repartition(4)
    for column in ("confidence_score", "complexity"):
        for descending in (False, True):
            pages = X.Pages.build(df, column, str(tmp_path / f"{column}-{descending}"), descending=descending, ranges=9)
            everything = [r["conversation_id"] for r in X.sort_rows(df, column, descending=descending).collect()]
            for number in (0, 1, 7, 14, 15, 99):
                page = pages.page(number, size=13)
                assert [r["conversation_id"] for r in page.collect()] == everything[number * 13 : number * 13 + 13]
    plan = pages.page(7, size=13)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and X.RANGE in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sum(pages.before[k + 1] > 7 * 13 and pages.before[k] < 8 * 13 for k in range(9)) <= 2
    assert X.Pages.build(df.limit(0), "complexity", str(tmp_path / "none")).page().count() == 0


def test_days_add_up(spark, tmp_path):
    words = ["debug the function", "which recipe can I cook?", "follow up, please", "xyz", "", "new idea"]
    rows = [(f"c{i}", words[i % 6] * (i % 40), ["en", None, "da"][i % 3], f"f{i % 5}") for i in range(120)]
    df = spark.createDataFrame(rows, "conversation_id string, text string, language string, source_file string")
    days = [df.filter(F.expr("substr(conversation_id, 2)").cast("int") % 3 == k) for k in range(3)]
    cases = [
        (lambda d: M.cli_facts(jobs.categorize_rows(d)), M.cli_report, M.metrics_cli(jobs.categorize_rows(df))),
        (lambda d: M.upload_facts(jobs.upload_rows(d)), M.upload_report, M.metrics_upload(jobs.upload_rows(df))),
        (M.summary_facts, M.summary_report, M.ingest_summary(df)),
    ]
    for n, (facts, report, whole) in enumerate(cases):
        path = str(tmp_path / str(n))
        for k, day in enumerate([*days, days[1]]):
            M.keep_facts(facts(day), path, f"day-{min(k, 2) if k < 3 else 1}")
        assert report(M.merged_facts(spark, path)).first() == whole.first()


def test_arrivals_are_taken_once(spark, tmp_path):
    def drop(name, *texts):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(json.dumps([{"uuid": t, "text": t} for t in texts]), encoding="utf-8")

    def job():
        return Arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), files_per_batch=1)

    assert job().rows().count() == 0
    drop("a.json", "one", "two")
    drop("b.json", "three")
    first = job()
    first.run()
    first.run()
    first.replay()
    assert sorted(r["conversation_id"] for r in first.rows().collect()) == ["one", "three", "two"]
    drop("c.json", "four")
    later = job()
    later.run()
    got = later.rows().select("conversation_id", "batch").collect()
    assert len(got) == 4 and len({r["batch"] for r in got}) == 3


def test_batches_are_timed(spark, tmp_path):
    df = spark.range(250).selectExpr("cast(id as string) as conversation_id", "concat('debug the function ', id) as text").repartition(3)
    out = str(tmp_path / "out")
    performance = jobs.run_categorize(spark, df, out, batch_size=20).first()["performance"]
    batches = spark.read.parquet(f"{out}/batches").collect()
    assert performance["rows"] == 250 == sum(b["rows"] for b in batches) and performance["batches"] == len(batches)
    assert performance["batch_size_used"] == 20 and all(0 < b["rows"] <= 20 and b["seconds"] >= 0 for b in batches)
    assert performance["slowest_batch_per_second"] == min(b["rows_per_second"] for b in batches)
