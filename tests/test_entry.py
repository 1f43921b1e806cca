from pathlib import Path

import pytest

import __spark_entry__ as entry
from talkmill.plans.oracle import ORACLE
from talkmill.plans.queries import QUERIES

SF_DIR = entry.SMOKE_DIR
TABLES = "documents embeddings benchmark conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_every_query_has_an_sql_check():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["main_category", "conversations"] and df.count() > 0


@pytest.mark.parametrize(
    "name",
    [
        "conv_categorize",
        "categorize",
        "metrics_upload",
        "language_id",
        "cache_misses",
        "language_misses",
        "file_conversations",
        "extract_fallback",
        "csv_upload_source",
    ],
)
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    expected = db.sql(entry.oracle_sql()[name])
    columns = sorted(expected.columns)
    got = entry.queries()[name](spark, SF_DIR)
    assert sorted(got.columns) == columns
    rows = sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect())))
    picked = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted(map(str, expected.project(picked).fetchall()))


def test_positions_run_on_over_the_parts_of_an_upload(spark, tmp_path, monkeypatch):
    from talkmill.plans import queries

    monkeypatch.setattr(queries, "shared_folder", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        test_query_matches_its_sql(spark, "default_fill")
        test_query_matches_its_sql(spark, "analyze_job")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "bare").glob("part-*.csv"))) > 1
