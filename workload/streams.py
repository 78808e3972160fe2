"""Streams over the events table read as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.functions import text as T
from logweir.operators.clusters import fit_log_clusters
from logweir.operators.mining import mine_templates
from logweir.operators.templates import hdfs_catalog
from logweir.session import materialise, scratch_path
from logweir.streaming import streams as X
from workload.detectors import NEAR_SQL, _count_vectors, _model
from workload.features import r
from workload.fixtures import L_SQL, is_train, raw_lines, event_lines, vectors
from workload.registry import query
from workload.templates import masked_lines


def as_stream(df, batches: int = 0):
    """The table as a file stream: all files at once, or one file per micro-batch."""
    spark = df.sparkSession
    path = scratch_path(spark, "stream-in")
    (df.repartition(batches) if batches else df).write.parquet(path)
    reader = spark.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", 1) if batches else reader).parquet(path)


def drain(stream, mode: str = "append"):
    """Run the stream over everything available and return what it wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream-out")
    done = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", scratch_path(spark, "stream-state"))
        .trigger(availableNow=True).start()
    )
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(f"""WITH {L_SQL} SELECT log_id, CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 2
  WHEN 'purchase' THEN 8 WHEN 'signup' THEN 25 ELSE 6 END AS template_id FROM l""")
def stream_assign(spark, sf_dir):
    lines = raw_lines(spark, sf_dir).withColumn("message", T.drop_columns("raw", range(5)))
    return drain(X.stream_assign(as_stream(lines, batches=4), hdfs_catalog()).select("log_id", "template_id"))


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS w, count(*) AS n,
  CASE WHEN bool_or(value > 200) THEN 'Anomalous' ELSE 'Normal' END AS label FROM events GROUP BY 1)
SELECT epoch(w)::BIGINT AS window_start, n, label FROM h
WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_hourly_sessions(spark, sf_dir):
    """Closed hours only: the last hours stay open behind the watermark."""
    lines = event_lines(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = drain(X.stream_sessions(as_stream(lines)))
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "n", "label")


@query(f"""WITH {NEAR_SQL} SELECT vec_id, cluster, round(dist, 6) + 0.0 AS dist,
  CASE WHEN dist > 0.4 THEN 'Anomalous' ELSE 'Normal' END AS predicted FROM near""")
def stream_score(spark, sf_dir):
    stream = as_stream(vectors(spark, sf_dir).select("vec_id", "vec"), batches=4)
    model = _model(spark, sf_dir)
    return drain(X.stream_score(stream, model)).select(
        "vec_id", "cluster", r("dist").alias("dist"), "predicted"
    )


@query("""SELECT count(*) AS templates, (SELECT count(*) FROM events)::BIGINT AS lines
FROM (SELECT DISTINCT event_type FROM events)""")
def stream_update_templates(spark, sf_dir):
    """Templates of one kind of line first, then all other lines arrive."""
    lines = materialise(masked_lines(spark, sf_dir), "lines")
    known = F.col("message").startswith("writeBlock")
    updater = X.TemplateUpdater(mine_templates(lines.filter(known)).templates)
    stream = as_stream(lines.filter(~known), batches=2)
    X.run_updates(stream, updater, scratch_path(spark, "stream-state")).awaitTermination()
    return updater.templates.agg(
        F.count("*").alias("templates"), F.sum("n").cast("bigint").alias("lines")
    )


@query()
def stream_cluster(spark, sf_dir):
    """Clusters of even users first, then the sessions of odd users arrive."""
    data = _count_vectors(spark, sf_dir, "event_type").select("session_id", "session_idx", "vec")
    start = fit_log_clusters(data.filter(is_train()), max_dist=0.1)
    updater = X.ClusterUpdater(start, max_dist=0.1)
    stream = as_stream(data.filter(~is_train()), batches=2)
    X.run_updates(stream, updater, scratch_path(spark, "stream-state")).awaitTermination()
    return updater.model.representatives.select("cluster", "size")
