"""Session settings and the shared folder used between stages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Runtime SQL settings the library is written for. All of them are Spark defaults or
# AQE switches: joins carry no size hints for data-dependent tables, so AQE picks
# broadcast or sort-merge from measured shuffle sizes and splits skewed partitions.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings to a session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where it names none, a local session (tests) uses a temporary folder; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "logweir")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/logweir-{name}-{uuid.uuid4().hex}"


# Shuffle files of a query go when it ends, not when the driver's JVM happens to collect its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Cuts the lineage of iterative operators; the files outlive lost executors. The stage's shuffles are deleted once it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


# Rows of this many bytes are broadcast at most; a row takes so many beside its text.
BROADCAST_BYTES = 4 << 20
ROW_BYTES = 32


def growing(df: DataFrame) -> DataFrame:
    """``df`` for a join with another table that grows, too: rows of both meet by a shuffle.

    A plan takes the size of a stage from its compressed files. Millions of alike rows look like a few MB there, and would be
    sent whole through the driver.
    """
    return df.hint("merge")


def sized(stage: DataFrame, text: str) -> DataFrame:
    """A written table for a join by ``text``: sent to every task if its rows take at most ``BROADCAST_BYTES``, else as `growing`."""
    size = stage.agg(F.sum(F.octet_length(text) + ROW_BYTES)).first()[0]
    return F.broadcast(stage) if (size or 0) <= BROADCAST_BYTES else growing(stage)


def discard(stage: DataFrame) -> None:
    """Empty a materialised stage that nothing reads any more; what is no stage stays as it is."""
    folders = {file.rpartition("/")[0] for file in stage.inputFiles()}
    if len(folders) == 1 and (path := folders.pop()).rpartition("/")[2].startswith("logweir-"):
        nothing = (F.lit(None).cast(f.dataType).alias(f.name) for f in stage.schema)
        stage.sparkSession.range(0, numPartitions=1).select(*nothing).write.mode("overwrite").parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy row work on an input with too few splits.

    Large inputs already have more splits than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
