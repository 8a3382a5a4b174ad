"""Lineage cuts: a table written under the folder the cluster names."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)  # tables of the innermost ``released`` of this thread


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, as the cluster (or a local session's owner) named it."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError(f"set {_KEY} to a folder every executor can reach")
    return root


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back: the plan restarts at a columnar scan.

    Spark drops the shuffle files of the writing job when it ends; nothing reads them again.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def _staged_in(df: DataFrame, scope: list[str] | None) -> DataFrame:
    path = f"{checkpoint_root(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    if scope is not None:
        scope.append(path)
    return write_once(df, path)


def stage(df: DataFrame) -> DataFrame:
    """``write_once`` under the shared folder."""
    return _staged_in(df, _staged.get())


@contextmanager
def released(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside are deleted at the end, but for those staged by the function this yields.

    Whatever is read later must be written by such a call, or elsewhere, before the end.
    """
    outer, own = _staged.get(), []
    token = _staged.set(own)
    try:
        yield lambda df: _staged_in(df, outer)
    finally:
        _staged.reset(token)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for name in own:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(hadoop).delete(path, True)
