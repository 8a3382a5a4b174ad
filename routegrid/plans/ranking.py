"""Row numbers inside groups of any size."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage


def numbered(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """1-based position of each row inside its group, ordered by ``order``.

    A plain ``row_number`` sorts a whole group in one task.  Here rows are range-partitioned
    on (group, order), the partition number is written down with the staged rows (so a
    retried task cannot change it), each slice is numbered on its own, and the slice counts
    of a group, at most one per partition, give the offsets.
    """
    sliced = stage(
        df.repartitionByRange(*[F.col(c) for c in group + order])
        .withColumn("_slice", F.spark_partition_id())
    )
    keys = group + ["_slice"]
    local = sliced.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        local.join(offsets, on=keys, how="inner")
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("int"))
        .drop("_slice", "_local", "_before")
    )


def first_by(df: DataFrame, group: list[str], order: Column, payload: list[str]) -> DataFrame:
    """One row per group, the one with the least ``order``; combines before the shuffle."""
    picked = F.min_by(F.struct(*payload), order)
    return df.groupBy(*group).agg(picked.alias("_p")).select(*group, "_p.*")
