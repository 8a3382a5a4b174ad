"""Cycles of large directed graphs, told from tables of key pairs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def long_walkers(edges: DataFrame, growth: int = 4) -> DataFrame:
    """``node``: every node on a cycle of ``edges(src, dst)``, and few others.

    Pairs joined by a walk of 1, 2, 4, ... edges: a node on a cycle always starts and ends one.
    Without a cycle no walk is left after log2(longest path) rounds.  Doubling stops early, and
    leaves more nodes, when the pairs outgrow ``growth`` times the edges.
    """
    walks = stage(edges.select("src", "dst").distinct())
    first = walks.count()
    size, before = first, None
    while size and size <= growth * first:
        on_both = walks.select(F.col("src").alias("node")).intersect(walks.select(F.col("dst").alias("node")))
        nodes = on_both.count()
        if not nodes:
            break
        if nodes == before:  # the last doubling freed no node: what is left is cycles and what lies between them
            return on_both
        before = nodes
        walks = stage(walks.join(walks.select(F.col("src").alias("dst"), F.col("dst").alias("_to")), "dst").select("src", F.col("_to").alias("dst")).distinct())
        size = walks.count()
    return walks.select(F.col("src").alias("node")).intersect(walks.select(F.col("dst").alias("node")))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges(src, dst)`` whose strong component has a cycle; the label is a key of the component.

    Colouring: every node takes the greatest key that reaches it; the nodes of one colour from
    which its own key is reached are a component.  What is left goes on to the next round.
    """
    edges = stage(edges.select("src", "dst").distinct())
    found: DataFrame | None = None
    while not edges.isEmpty():
        ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        colour = _settled_colours(edges, stage(ends.withColumn("label", F.col("node"))))
        inside = edges.join(colour.select(F.col("node").alias("src"), "label"), "src").join(
            colour.select(F.col("node").alias("dst"), F.col("label").alias("_other")), "dst").where("label = _other").select("src", "dst", "label")
        inside = stage(inside)
        reached = stage(colour.where("node = label"))
        level = reached
        while not level.isEmpty():
            back = inside.join(level.select(F.col("node").alias("dst"), "label"), ["dst", "label"]).select(F.col("src").alias("node"), "label").distinct()
            level = stage(back.join(reached, ["node", "label"], "left_anti"))
            reached = stage(reached.unionByName(level))
        looped = inside.join(reached.select(F.col("node").alias("src"), "label"), ["src", "label"], "left_semi").join(
            reached.select(F.col("node").alias("dst"), "label"), ["dst", "label"], "left_semi")
        cyclic = stage(reached.join(looped.select("label").distinct(), "label", "left_semi").select("node", "label"))
        found = cyclic if found is None else found.unionByName(cyclic)
        gone = reached.select("node")
        edges = stage(edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("label")) if found is None else found


def _settled_colours(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """The greatest label that reaches each node, its own included."""
    while True:
        coming = edges.join(colour.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("_more"))
        after = stage(colour.join(coming, "node", "left").select(
            "node", F.greatest("label", "_more").alias("label"), F.coalesce(F.col("_more") > F.col("label"), F.lit(False)).alias("_new")))
        if after.where("_new").isEmpty():
            return after.drop("_new")
        colour = after.drop("_new")
