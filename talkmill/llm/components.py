"""Connected components of links, by alternating stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talkmill.sources.store import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the least of its neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.join(_least(both).withColumn("least", F.least("a", "least")), "a")
    return met.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them."""
    met = links.join(_least(links), "a")
    out = met.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.union(met.select("a", F.col("least").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of a link with the least node it reaches.

    Links of a node with itself and links with a null end are left out. A round joins links with the
    least neighbour of each node, one row per node, so the many links of one hub can be split.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    links = written(ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (mark := _mark(links)) != before:
        before = mark
        if not mark[0]:
            break
        links = written(_small_star(_large_star(links)), "links")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
