"""Connected components of a links table, by alternating large-star and small-star rounds.

Each round is two aggregations and joins over the links; nodes are never gathered. A large star keeps at
most as many links as there were, and their number falls to one a node. Every round's links are written
to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scanloom.llm.texts import written


def _least(links: DataFrame) -> DataFrame:
    """Smallest neighbour of every node, the node itself included."""
    return links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b: comparable values; direction, repeats and self-links don't matter)."""
    now = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours go to the smallest neighbour
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = written(large)
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select("a", F.col("m").alias("b"))).distinct()
        now = written(small)
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if sign == before or not sign[0]:
            break
        before = sign
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
