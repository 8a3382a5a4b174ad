"""Level-by-level work on graphs stored as tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def grow(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Staged levels start, step(start), ... until one is empty.

    Each level is written before the next one reads it, so plans stay one level long and a
    lost executor costs a re-read, not the whole history.
    """
    levels = []
    level = stage(start)
    while not level.isEmpty():
        levels.append(level)
        level = stage(step(level))
    return levels or [level]


def union_all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def closure(start: DataFrame, edges: DataFrame, keys: list[str], growth: int = 8) -> DataFrame:
    """Nodes reached from ``start(*keys, node)`` over ``edges(*keys, node, next)``, start included.

    Reach is doubled first: pairs joined by at most 1, 2, 4, ... edges, while the table stays
    under ``growth`` times the edges.  Where it stops growing, one join with the start is the
    whole closure.  Otherwise rounds go on from the frontier, each over as many edges as the
    doubled pairs hold; a level keeps only nodes not seen before, so cycles end.
    """
    start = stage(start.select(*keys, "node").distinct())
    asked = start.select(*keys).distinct()
    pairs = stage(edges.select(*keys, "node", "next").join(asked, keys, "left_semi").distinct())
    first = size = pairs.count()
    whole = not first
    while not whole and size <= growth * first:
        ahead = pairs.withColumnsRenamed({"node": "_via", "next": "_to"})
        behind = pairs.withColumnRenamed("next", "_via")
        longer = stage(behind.join(ahead, [*keys, "_via"]).select(*keys, "node", F.col("_to").alias("next")).unionByName(pairs).distinct())
        pairs, before, size = longer, size, longer.count()
        whole = size == before
    levels = [start]
    while True:
        found = levels[-1].join(pairs, [*keys, "node"]).select(*keys, F.col("next").alias("node")).distinct()
        if whole:
            return start.unionByName(found).distinct()
        fresh = stage(found.join(union_all(levels), [*keys, "node"], "left_anti"))
        if fresh.isEmpty():
            return union_all(levels)
        levels.append(fresh)
