"""Connected components of a graph of links."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links(a, b)``; the label is the least node of its component.

    Large-star and small-star steps in turn (each a minimum per node, combined before the
    shuffle, and a join that Spark may split for hot nodes) until nothing changes.  No component
    is ever gathered in one place.
    """
    edges = stage(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def small(df: DataFrame) -> DataFrame:
        """Few files for few edges: there are never more than at the start."""
        return stage(df.coalesce(1 + edge_count // 250_000))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    before, now = None, state(edges)
    edge_count = now[0]
    while now != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = small(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small(rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, now = now, state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
