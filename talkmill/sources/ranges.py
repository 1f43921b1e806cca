"""Large files read by many tasks although a record may span lines, strings and splits.

Spark deals a file's bytes out in splits, and its text source gives what lies between separators, with the place of the split.
Whether a separator is one or stands inside a quoted field or a string depends on all that comes before. So a first scan
tells of every split what it does to each state it may begin in; the driver, which plans the splits anyway, composes these
few numbers in file order; a second scan, knowing how each of its splits begins, cuts it into records. What a split has of a
record that began before it or ends after it is a fragment; fragments alone are shuffled, by record. Without any, there
is no such step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class File:
    path: str
    name: str


@dataclass
class Chunks:
    """Text between separators as ``file, start, length, size, value``, and the files by number."""

    rows: DataFrame
    files: dict[int, File]

    def measured(self, measure: Callable, schema: str) -> dict[int, list]:
        """The rows ``measure`` makes of each split, file by file, in the order of the file."""
        found = self.rows.mapInArrow(measure, f"file long, start long, length long, size long, {schema}").collect()
        splits: dict[int, list] = {}
        for r in sorted(found, key=lambda r: (r["file"], r["start"])):
            splits.setdefault(r["file"], []).append(r)
        return splits

    def cut(self, cutter: Callable[[bool], Callable], schema: str, crossing: bool, key: list[str], separator: str) -> DataFrame:
        """Records of ``cutter(False)``, and those put together from the fragments of ``cutter(True)``.

        Both give ``schema``, ``part long`` and ``record string``; ``part`` orders the fragments of a record.
        """
        columns = [field.split()[0] for field in schema.split(", ")]
        full = f"file long, {schema}, part long, record string"
        whole = self.rows.mapInArrow(cutter(False), full).select(*columns, "record")
        if not crossing:
            return whole
        parts = F.array_sort(F.collect_list(F.struct("part", "record")))
        text = F.array_join(F.transform(parts, lambda p: p["record"]), separator)
        same = [F.min(c).alias(c) for c in columns if c not in key]
        joined = self.rows.mapInArrow(cutter(True), full).groupBy(*key).agg(*same, text.alias("record"))
        return whole.unionByName(joined.select(*columns, "record"))


def read_chunks(spark: SparkSession, paths: str | list[str], separator: str, pattern: str | None = None) -> Chunks:
    """All files under ``paths``, between separators."""
    source = spark.read.option("lineSep", separator)
    if pattern:
        source = source.option("pathGlobFilter", pattern)
    texts = source.text(paths)
    # A local file's address has one slash in one place and three in the other.
    slashes = (F.lit("^([^:/]+):/+"), F.lit("$1:/"))
    number = F.xxhash64(F.regexp_replace("_metadata.file_path", *slashes))
    rows = texts.select(
        number.alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )
    listed = spark.createDataFrame([(p,) for p in texts.inputFiles()], "path string")
    files = {n: File(unquote(p), unquote(p).rsplit("/", 1)[-1]) for p, n in listed.select("path", F.xxhash64(F.regexp_replace("path", *slashes))).collect()}
    if len(files) < listed.count():
        raise ValueError("two file names have one hash")
    return Chunks(rows, files)


def split_key(split) -> tuple[int, int, int, int]:
    return split["file"], split["start"], split["length"], split["size"]


def split_runs() -> Callable:
    """A function, sent by value to the tasks, from batches to ``(file, start, length, size), values`` of one split each, in order."""

    def runs(batches) -> Iterator[tuple]:
        import numpy as np

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)])
            new = np.flatnonzero((keys[:2, 1:] != keys[:2, :-1]).any(axis=0)) + 1
            edges = [0, *new.tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    yield tuple(keys[:, a].tolist()), batch.column(4).slice(a, b - a)

    return runs


def of_split(splits: dict[tuple, tuple]) -> Callable:
    """What is known of a split; the scan must deal files out as the first one did."""

    def known(key: tuple) -> tuple:
        try:
            return splits[key]
        except KeyError:
            raise RuntimeError("the cluster dealt files out otherwise in the second scan; read them again") from None

    return known
