"""Session settings the jobs rely on; values the cluster already chose are kept."""
from __future__ import annotations

from pyspark.sql import SparkSession

# Every per-molecule stage is hash-partitioned on ``mol_id`` once; joins and windows whose
# keys start with it must be allowed to reuse that layout.  AQE splits skewed join
# partitions, including those below an aggregate on the same key.
_WANTED = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # groups here are single atoms or molecules: many and small
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in _WANTED.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "routegrid", cores: str = "8", partitions: int = 8, folder: str | None = None) -> SparkSession:
    """A single-machine session for tests and the bench; ``folder`` takes its staged tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if folder:
        spark.sparkContext.setCheckpointDir(folder)
    return tune(spark)
