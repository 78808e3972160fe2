"""Online use: template assignment, time sessions, cluster updates and scoring of streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from logweir.operators.clusters import LogClusterModel, fit_log_clusters
from logweir.operators.mining import MiningConfig, update_templates
from logweir.operators.sessions import label_of
from logweir.operators.templates import match_templates
from logweir.session import scratch_path


def stream_assign(
    lines: DataFrame, catalog: list[tuple[int, str]], fallback_col: str | None = None
) -> DataFrame:
    """Template ids of arriving lines: a stateless projection over a fitted catalog."""
    return match_templates(lines, catalog, fallback_col=fallback_col)


def stream_sessions(
    lines: DataFrame, window: str = "1 hour", watermark: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """(window_start, n, label) of closed time windows; lines behind the watermark are late."""
    stamped = lines.withColumn("_ts", F.col(ts).cast("timestamp"))
    grouped = stamped.withWatermark("_ts", watermark).groupBy(F.window("_ts", window).alias("w"))
    return grouped.agg(
        F.count("*").alias("n"), label_of(F.max("is_alert")).alias("label")
    ).select(F.col("w.start").alias("window_start"), "n", "label")


def stream_score(vectors: DataFrame, model) -> DataFrame:
    """Score arriving session vectors by a fitted detector with a stateless transform."""
    return model.transform(vectors)


class ModelTable:
    """A small model table with one version per batch below a shared path.

    A new updater on the same path starts from the last version, and a batch that is replayed after a restart is
    recognised by its id. A version counts once its number is written, after its table.
    """

    def __init__(self, first: DataFrame, path: str):
        self.spark, self.path, self.schema = first.sparkSession, path.rstrip("/"), first.schema
        try:
            self.batch = self.spark.read.parquet(f"{self.path}/versions").agg(F.max("batch")).first()[0]
        except AnalysisException:  # nothing was written there yet
            self.advance(first, -1)

    def current(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch-{self.batch}")

    def advance(self, table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        version = self.spark.createDataFrame([(batch,)], "batch bigint").coalesce(1)
        version.write.mode("append").parquet(f"{self.path}/versions")
        self.batch = batch


class TemplateUpdater:
    """Keeps a template table up to date while lines arrive; ``path`` makes it outlive a restart."""

    def __init__(
        self, templates: DataFrame, config: MiningConfig = MiningConfig(), path: str | None = None
    ):
        path = path or scratch_path(templates.sparkSession, "online-templates")
        self.state = ModelTable(templates, path)
        self.config = config

    @property
    def templates(self) -> DataFrame:
        return self.state.current()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id > self.state.batch and not batch.isEmpty():
            self.state.advance(update_templates(self.templates, batch, self.config), batch_id)


class ClusterUpdater:
    """Keeps cluster representatives up to date while session vectors arrive; ``path`` as above."""

    def __init__(
        self, model: LogClusterModel, max_dist: float = 0.3, order: str = "session_idx",
        path: str | None = None,
    ):
        path = path or scratch_path(model.representatives.sparkSession, "online-clusters")
        self.state = ModelTable(model.representatives, path)
        self.start = model
        self.max_dist = max_dist
        self.order = order

    @property
    def model(self) -> LogClusterModel:
        return replace(self.start, representatives=self.state.current())

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id > self.state.batch and not batch.isEmpty():
            fitted = fit_log_clusters(
                batch, self.max_dist, self.start.anomaly_threshold, order=self.order,
                start=self.state.current(),
            )
            self.state.advance(fitted.representatives, batch_id)


def run_updates(stream: DataFrame, updater, checkpoint: str) -> StreamingQuery:
    """Feed all available data of a stream to an updater, batch by batch."""
    return (
        stream.writeStream.foreachBatch(updater)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
