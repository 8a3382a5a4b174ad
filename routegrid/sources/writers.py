"""Output files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_routes(df: DataFrame, root: str) -> None:
    """JSON under ``folder=/run=``; readers prune by both.  Other folders and runs there stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder", "run").json(root)


def write_documents(df: DataFrame, root: str, key: str, text: str) -> None:
    """One file per row: the text under ``key=<value>/``.

    Making a folder costs more than its text, so the rows are dealt over all tasks, however small
    they are, and each task moves its own files in place; the driver would do so one by one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.select(key, F.col(text).alias("value")).repartition(n, key).write.option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).text(root)


def save_result(df: DataFrame, path: str) -> None:
    """``target, saved_at, result``: the latest result per target replaces the stored set."""
    latest = df.groupBy("target").agg(F.max_by("result", "saved_at").alias("result"))
    latest.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, lists: list[str], keep: Column | None = None) -> None:
    """A10: the rows with ``keep`` (all without one), list columns as JSON text."""
    out = df if keep is None else df.where(keep)
    for c in lists:
        out = out.withColumn(c, F.to_json(c))
    out.write.mode("overwrite").csv(path, header=True, escape='"')


def write_judged(results: DataFrame, root: str) -> DataFrame:
    """L2 and L3 in one job: rows of ``results(status, elapsed, ...)`` go to ``root/status=ok`` and, the others, to ``root/status=error``.

    Returns the report (``status, n, share, mean_elapsed``), whose figures are observed while the
    rows are written; nothing is read a second time.  A null status is an error.
    """
    judged = results.withColumn("status", F.when(F.col("status") == "ok", "ok").otherwise("error"))
    seen = Observation()
    figures = [m for x in ("ok", "error") for m in (
        F.count_if(F.col("status") == x).alias(f"{x}_n"), F.avg(F.when(F.col("status") == x, F.col("elapsed"))).alias(f"{x}_elapsed"))]
    judged.observe(seen, *figures).write.partitionBy("status").parquet(root)
    got = seen.get
    whole = got["ok_n"] + got["error_n"]
    rows = [(x, got[f"{x}_n"], round(got[f"{x}_n"] / whole, 6), None if got[f"{x}_elapsed"] is None else round(got[f"{x}_elapsed"], 6)) for x in ("ok", "error") if got[f"{x}_n"]]
    return results.sparkSession.createDataFrame(rows, "status string, n long, share double, mean_elapsed double")
