"""Connected components of an edge table by alternating large-star and small-star steps (joins and minima only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b); the root is the least node of the component.

    Each step writes its small tables to the shared folder, so lineage stays short, and deletes those before. Minima are
    written before edges are joined to them: then both sides of the join are plain tables, and Spark splits the edges of a
    node that has very many. Null nodes and loops are ignored.
    """
    now = settle(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        large = settle(both.join(least, "a").filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after_now = settle(small.distinct())
        discard(now, least, large, low)
        now, after = after_now, _state(after_now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
