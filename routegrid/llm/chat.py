"""Chat formatting: logged snapshots of one conversation are collapsed, the longest are rendered."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

# The markers of a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE + "\n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2): rolling hash of the first ``place`` turns of each conversation.

    The hash of a turn covers its place, role and text; the rolling hash is their running XOR,
    so a conversation's slices can be worked on apart and put together.  Turns are ordered by
    turn, then role and text.  A conversation is cut into slices of the turn number so that a very
    long one is not sorted in one task.
    """
    rows = turns.select(
        "conv_id", F.floor(F.coalesce("turn", F.lit(-1)) / 256).alias("slice"), "turn", F.xxhash64("role", "text").alias("content"),
        F.xxhash64("text", F.lit(7), "role").alias("content2"))
    rows = stage(rows)
    sizes = rows.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inside = Window.partitionBy("conv_id", "slice").orderBy("turn", "content", "content2")
    placed = rows.withColumn("local", F.row_number().over(inside))
    same = placed["conv_id"].eqNullSafe(offsets["conv_id"]) & (placed["slice"] == offsets["slice"])
    placed = placed.join(offsets, same).select(placed["conv_id"], placed["slice"], (F.col("before") + F.col("local")).alias("place"), "content", "content2")
    placed = placed.select("conv_id", "slice", "place", F.xxhash64("place", "content").alias("x1"), F.xxhash64("content2", "place").alias("x2"))
    placed = stage(placed)
    totals = placed.groupBy("conv_id", "slice").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    carried = totals.select("conv_id", "slice", *[F.coalesce(F.bit_xor(t).over(ahead), F.lit(0)).alias(c) for t, c in (("t1", "c1"), ("t2", "c2"))])
    running = Window.partitionBy("conv_id", "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("conv_id", "slice", "place", F.bit_xor("x1").over(running).alias("r1"), F.bit_xor("x2").over(running).alias("r2"))
    same = local["conv_id"].eqNullSafe(carried["conv_id"]) & (local["slice"] == carried["slice"])
    return local.join(carried, same).select(
        local["conv_id"], "place", F.col("r1").bitwiseXOR(F.col("c1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("c2")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no other one extends or, with a smaller id, equals.

    Anti-joins on the rolling hashes: distinct proper prefixes against whole conversations.
    Both sides are distinct, so a first turn or a whole conversation that very many share is one row.
    """
    rolling = stage(prefixes(turns))
    last = rolling.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("whole")).select("conv_id", "whole.*")
    firsts = last.groupBy("place", "h1", "h2").agg(F.min_by("conv_id", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("conv_id"))
    lengths = last.withColumnsRenamed({"conv_id": "_id", "place": "n"}).select("_id", "n")
    proper = rolling.join(lengths, rolling["conv_id"].eqNullSafe(lengths["_id"])).where("place < n").select("place", "h1", "h2").distinct()
    return firsts.join(proper, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def chat_texts(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, text: every maximal conversation, rendered turn by turn.

    A conversation logged again and again as it grows leaves rows that prefix a longer one;
    these and equal copies (all but the least id) go.  Turns run by turn number, then role and
    text hash; a null role or text renders as empty, a null turn comes first, and rows with a
    null conv_id are one conversation.  Repeated rows are turns of their own.
    """
    kept = maximal(turns)
    rows = turns.select(
        "conv_id", "turn", F.xxhash64("role", "text").alias("content"), F.xxhash64("text", F.lit(7), "role").alias("content2"),
        rendered_turn(F.col("role"), F.col("text")).alias("piece"))
    kept = kept.withColumnRenamed("conv_id", "_id")
    mine = rows.join(kept, rows["conv_id"].eqNullSafe(kept["_id"]))
    pieces = F.array_sort(F.collect_list(F.struct("turn", "content", "content2", "piece")))
    return mine.groupBy("conv_id").agg(F.first("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"))
