"""The query set of this repository with the SQL each query is checked against."""

from __future__ import annotations

import importlib
import os

AREAS = ["text", "templates", "sessions", "splits", "features", "detectors", "evaluation",
         "files", "streams"]


def load():
    """(queries, oracles) of every area."""
    from workload.registry import ORACLES, QUERIES

    for area in AREAS:
        importlib.import_module(f"workload.{area}")
    return dict(QUERIES), dict(ORACLES)


def local_session():
    """A local session for tests and the benchmark."""
    from pyspark.sql import SparkSession

    from logweir.session import RECOMMENDED

    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logweir")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
