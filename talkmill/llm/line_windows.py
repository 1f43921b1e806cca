"""Line dedup over overlapping windows of three consecutive lines.

A window is the hash of three consecutive lines of one text; windows of three blank lines are left out.
Of a window found more than once anywhere, the occurrence with the least (id, row key, position) is the
first; every line covered by a later occurrence is removed, overlapping occurrences merged. Windows are
judged on the input. Texts of fewer than three lines (null and empty ones too) have no window and stay
as they are. Rows that repeat both id and text are one row for the decision and all of them get it; all
other columns pass through, whatever their names.

Only hashes and positions are shuffled by window, counted before they meet; a hot window is a hot join
key, which adaptive execution splits, since its other side holds one row per hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talkmill.llm.rows import row_key, text_or_empty

WINDOW = 3


def line_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, pos, hash) of every window, once for each distinct row."""
    lines = df.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.split(text_or_empty(text_col), "\n", -1).alias("line"))
    lines = lines.filter(F.size("line") >= WINDOW)
    hashed = lines.select("id", "key", "line", F.expr("transform(line, x -> unhex(md5(x)))").alias("h"))
    blank = " and ".join(f"trim(line[i+{k}]) = ''" for k in range(WINDOW))
    whole = ", ".join(f"h[i+{k}]" for k in range(WINDOW))
    hashes = f"transform(sequence(0, size(h) - {WINDOW}), i -> if({blank}, null, unhex(md5(concat({whole})))))"
    windows = hashed.select("id", "key", F.posexplode(F.expr(hashes)).alias("pos", "hash"))
    return windows.filter(F.col("hash").isNotNull())


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with their kept lines in text_col, and n_lines, n_removed beside them in one struct column each row: (row, n_lines, n_removed)."""
    windows = line_windows(df, id_col, text_col)
    place = F.struct("id", "key", "pos")
    first = windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    later = windows.join(first.select("hash", "first"), "hash").filter(place > F.col("first"))
    covered = later.groupBy("key").agg(F.collect_set("pos").alias("starts"))
    rows = df.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"), text_or_empty(text_col).alias("text"))
    merged = rows.join(covered, "key", "left")
    return merged.selectExpr("row", "text", "split(text, '\\n', -1) as line", "starts").selectExpr(
        "row",
        "cast(size(line) as bigint) as n_lines",
        # The places left over are found by a set of the covered ones, so a text of many lines costs no more a line.
        f"""if(starts is null, line, transform(
            array_except(sequence(0, size(line) - 1), flatten(transform(starts, s -> sequence(s, s + {WINDOW - 1})))),
            i -> line[i])) as kept""",
    ).selectExpr("row", "n_lines", "n_lines - size(kept) as n_removed", "array_join(kept, '\\n') as kept")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with repeated lines gone from text_col; a null text stays null. Columns as in df."""
    done = drop_repeated_lines(df, id_col, text_col)
    changed = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row").getField(text_col))
    return done.select(*(changed.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns))


def line_dedup_query(spark, sf_dir: str) -> DataFrame:
    """What line dedup leaves of each document."""
    done = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.selectExpr("row.doc_id as doc_id", "n_lines", "n_removed", "sha2(kept, 256) as kept_sha256")


LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS line FROM documents
), windows AS (
  SELECT doc_id, text, i AS pos, line[i + 1] || chr(10) || line[i + 2] || chr(10) || line[i + 3] AS w,
         trim(line[i + 1], ' ') = '' AND trim(line[i + 2], ' ') = '' AND trim(line[i + 3], ' ') = '' AS blank
  FROM (SELECT *, unnest(range(len(line) - 2)) AS i FROM lines WHERE len(line) >= 3)
), ranked AS (
  SELECT doc_id, text, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM windows WHERE NOT blank
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS place FROM ranked, (SELECT unnest(range(3)) AS k) WHERE n > 1
), kept AS (
  SELECT l.doc_id, l.place, l.x, c.place IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(line) AS x, unnest(range(len(line))) AS place FROM lines) l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.place = l.place
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""
