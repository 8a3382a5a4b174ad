"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "_row_key"


def row_key(*columns: str) -> Column:
    """Identity of a row by its content: repeated rows share it, other rows with the same id do not."""
    return F.xxhash64(*columns)


def texts(docs: DataFrame) -> DataFrame:
    """(_row_key, doc_id, text) of a table; other columns, whatever their names, are left behind."""
    return docs.select(row_key("doc_id", "text").alias(KEY), "doc_id", "text")


def join_rows(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (_row_key, doc_id), a null id equal to a null id; the left side's keys stay."""
    right = right.withColumnsRenamed({KEY: "_right_key", "doc_id": "_right_id"})
    same = (left[KEY] == right["_right_key"]) & left["doc_id"].eqNullSafe(right["_right_id"])
    return left.join(right, same, how).drop("_right_key", "_right_id")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of a few megabytes, unless the session has a size of its own: buffers on both sides follow it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


HASHES = 1 << 40


def hash_bounds(keys: DataFrame, group: str, most: int, bins: int = 1024) -> dict:
    """For each group of ``keys(group, at, n)``, with ``at`` under 2**40, a bound: ``n`` of the hashes below it reaches ``most``.

    Histograms of ever narrower ranges, all groups in one pass, so that ``n`` below the bound is
    less than twice ``most`` (or one hash more), however many rows there are; a group with less
    is taken whole.  The driver sees ``bins`` sums a group.
    """
    spark, kind = keys.sparkSession, keys.schema[group].dataType.simpleString()
    bounds: dict = {}
    open_ = {r[0]: (0, HASHES, 0) for r in keys.select(group).distinct().collect()}
    while open_:
        ranges = [(g, low, high, max(1, (high - low) // bins)) for g, (low, high, _) in open_.items()]
        wanted = spark.createDataFrame(ranges, f"{group} {kind}, low long, high long, width long")
        found = keys.join(F.broadcast(wanted), group).where("at >= low AND at < high").groupBy(
            group, F.expr("(at - low) div width").alias("bin")).agg(F.sum("n").alias("n")).orderBy(group, "bin").collect()
        for g, low, high, width in ranges:
            have = open_.pop(g)[2]
            bounds[g] = high
            for r in (r for r in found if r[group] == g):
                if have + r["n"] >= most:
                    start = low + r["bin"] * width
                    bounds[g] = min(high, start + width)
                    if r["n"] > most and width > 1:
                        open_[g] = (start, bounds[g], have)
                    break
                have += r["n"]
    return bounds


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def batch_of(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()})


def list_of(values, offsets) -> pa.Array:
    """A list column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
