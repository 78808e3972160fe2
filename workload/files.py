"""Text sources and sinks: every query writes data derived from the tables and reads it back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from logweir.operators.sessions import label_of
from logweir.operators.templates import hdfs_catalog
from logweir.session import scratch_path
from logweir.sources import lines as L
from logweir.sources import tables as A
from logweir.sources.datasets import SPECS, load_dataset
from workload.detectors import PU_SQL, pu
from workload.fixtures import (
    D_SQL, L_SQL, M_SQL, S_SQL, document_lines, members, raw_lines, sequences, sessions, table, vectors,
)
from workload.registry import query


@query(f"""WITH {L_SQL} SELECT log_id, raw FROM l WHERE log_id % 13 <> 0""")
def read_log_lines(spark, sf_dir):
    """Every 13th line is blank."""
    path = scratch_path(spark, "log")
    blank = F.when(F.col("log_id") % 13 == 0, F.lit("  ")).otherwise(F.col("raw"))
    L.write_log_lines(raw_lines(spark, sf_dir).withColumn("raw", blank), path)
    return L.read_log_lines(spark, path)


@query(f"""WITH {D_SQL}, t AS (
  SELECT row_number() OVER (ORDER BY log_id) - 1 AS log_id,
         trim(regexp_replace(raw, '[^\\x{{20}}-\\x{{7e}}\\x{{a1}}-\\x{{ff}}]', ' ', 'g')) AS raw FROM d)
SELECT log_id, md5(raw) AS digest FROM t WHERE raw <> ''""")
def read_latin_lines(spark, sf_dir):
    """Document lines written in ISO-8859-1 (characters outside become blanks)."""
    path = scratch_path(spark, "latin")
    kept = F.regexp_replace("raw", r"[^\x20-\x7e\xa1-\xff]", " ")
    encoded = F.encode(F.trim(kept), "ISO-8859-1").cast("string")
    L.write_log_lines(document_lines(spark, sf_dir).select("log_id", encoded.alias("raw")), path)
    return L.read_log_lines(spark, path, "ISO-8859-1").select("log_id", F.md5("raw").alias("digest"))


@query("""SELECT count(*) AS total, count(*) FILTER (value > 200) AS alerts FROM events
WHERE event_id < (SELECT count(*) FROM events) // 2""")
def head_extract(spark, sf_dir):
    from workload.fixtures import alert_lines_raw

    lines = alert_lines_raw(spark, sf_dir)
    return L.alert_count(L.head_extract(lines, lines.count() // 2))


LABELS_SQL = """SELECT CAST(doc_id AS VARCHAR) AS session_id,
  CASE WHEN toxic = 1 THEN 'Anomalous' ELSE 'Normal' END AS label FROM labels"""


def _label_file(spark, sf_dir, sep):
    path = scratch_path(spark, "labels")
    name = F.when(F.col("toxic") == 1, "Anomaly").otherwise("Normal")
    rows = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("session_id"), name.alias("label")
    )
    A.write_labels(rows, path, sep)
    return A.read_labels(spark, path, sep)


@query(LABELS_SQL)
def read_labels(spark, sf_dir):
    return _label_file(spark, sf_dir, ",")


@query(LABELS_SQL)
def read_labels_colon(spark, sf_dir):
    return _label_file(spark, sf_dir, ":")


@query(f"WITH {M_SQL} SELECT session_id, pos, log_id FROM m")
def sequence_file(spark, sf_dir):
    path = scratch_path(spark, "sequences")
    A.write_sequences(members(spark, sf_dir), path)
    return A.read_sequences(spark, path)


@query("SELECT CAST(doc_id AS INT) AS template_id, md5(trim(replace(text, chr(10), ', '))) AS digest FROM documents")
def template_file(spark, sf_dir):
    path = scratch_path(spark, "templates")
    A.write_templates(
        table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("template_id"),
            F.trim(F.regexp_replace("text", "\n", ", ")).alias("template"),
        ),
        path,
    )
    return A.read_templates(spark, path).select("template_id", F.md5("template").alias("digest"))


@query("SELECT event_id AS log_id, CAST(length(event_type) AS INT) AS template_id FROM events")
def log_event_file(spark, sf_dir):
    path = scratch_path(spark, "log-events")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"), F.length("event_type").alias("template_id")
    )
    A.write_log_events(events, path)
    return A.read_log_events(spark, path)


def _vector_rows(df, key):
    add = lambda acc, x: acc + x
    return df.select(
        key,
        F.size("vec").cast("bigint").alias("d"),
        (F.round(F.aggregate("vec", F.lit(0.0), add), 5) + 0.0).alias("total"),
    )


_TOTAL = "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) + 0.0"


@query(f"SELECT 'w' || CAST(vec_id AS VARCHAR) AS token, 64::BIGINT AS d, {_TOTAL} AS total FROM embeddings")
def vector_file(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    token = F.concat(F.lit("w"), F.col("vec_id").cast("string"))
    A.write_vectors(vectors(spark, sf_dir).withColumn("token", token), path)
    return _vector_rows(A.read_vectors(spark, path), "token")


@query(f"""SELECT 'w' || CAST(label AS VARCHAR) AS token, 64::BIGINT AS d, {_TOTAL} AS total FROM embeddings
QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1""")
def vector_file_header(spark, sf_dir):
    """Header line, repeated words and lines of a wrong length."""
    path = scratch_path(spark, "vectors")
    text = F.array_join(F.col("vec").cast("array<string>"), " ")
    v = vectors(spark, sf_dir)
    rows = v.select(
        (F.col("vec_id") * 2 + 2).alias("log_id"),
        F.concat_ws(" ", F.concat(F.lit("w"), F.col("label").cast("string")), text).alias("raw"),
    )
    broken = v.select(
        (F.col("vec_id") * 2 + 1).alias("log_id"),
        F.concat(F.lit("w"), F.col("label").cast("string"), F.lit(" 1.0 2.0")).alias("raw"),
    )
    head = v.agg(F.count("*").alias("n")).select(
        F.lit(0).cast("bigint").alias("log_id"), F.concat(F.col("n").cast("string"), F.lit(" 64")).alias("raw")
    )
    L.write_log_lines(head.unionByName(rows).unionByName(broken), path)
    return _vector_rows(A.read_vectors(spark, path, header=True), "token")


@query(f"SELECT CAST(vec_id AS INT) AS template_id, 64::BIGINT AS d, {_TOTAL} AS total FROM embeddings")
def event_vector_file(spark, sf_dir):
    path = scratch_path(spark, "event-vectors")
    A.write_event_vectors(vectors(spark, sf_dir).withColumnRenamed("vec_id", "template_id"), path)
    return _vector_rows(A.read_event_vectors(spark, path), "template_id")


@query(f"""WITH {S_SQL}, q AS (SELECT session_id, string_agg(event_key, ' ' ORDER BY pos) AS line
  FROM m GROUP BY 1)
SELECT line, count(*) AS n FROM (SELECT line FROM q UNION ALL
  SELECT session_id || ',' || label || ',Normal,0.5' FROM s UNION ALL SELECT '' FROM s) GROUP BY line""")
def instance_file(spark, sf_dir):
    """Lines of the instance file with their number."""
    path = scratch_path(spark, "instances")
    scored = (
        sessions(spark, sf_dir).withColumn("predicted", F.lit("Normal"))
        .withColumn("confidence", F.lit(0.5))
    )
    A.write_instances(sequences(spark, sf_dir), scored, path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(f"""WITH {PU_SQL} SELECT CAST(session_id AS VARCHAR) AS session_id, predicted,
  round(confidence, 6) + 0.0 AS confidence FROM pc""")
def pu_label_file(spark, sf_dir):
    path = scratch_path(spark, "pu-labels")
    A.write_pu_labels(pu(spark, sf_dir), path)
    return A.read_pu_labels(spark, path).withColumn("confidence", F.round("confidence", 6) + 0.0)


@query(f"WITH {PU_SQL} SELECT CAST(session_id AS VARCHAR) AS session_id FROM pc WHERE rule = 'distance'")
def missing_pu_labels(spark, sf_dir):
    """Sessions without an entry when only cluster and labelled decisions were written."""
    path = scratch_path(spark, "pu-labels")
    labels = pu(spark, sf_dir)
    A.write_pu_labels(labels.filter(F.col("rule") != "distance"), path)
    ids = labels.select(F.col("session_id").cast("string").alias("session_id"))
    return A.missing_pu_labels(ids, A.read_pu_labels(spark, path))


@query("""SELECT 'blk_' || CAST(user_id AS VARCHAR) AS session_id, count(*) AS n_events,
  CASE WHEN bool_or(value > 200) THEN 'Anomalous' ELSE 'Normal' END AS label
FROM events GROUP BY user_id""")
def load_hdfs_dataset(spark, sf_dir):
    """Registry entry with the fixed catalog: log and label files to unsplit instances."""
    log, labels = scratch_path(spark, "log"), scratch_path(spark, "labels")
    L.write_log_lines(raw_lines(spark, sf_dir), log)
    alert = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.col("value") > 200).alias("a"))
    A.write_labels(
        alert.select(
            F.concat(F.lit("blk_"), F.col("user_id").cast("string")).alias("session_id"),
            F.when(F.col("a"), "Anomaly").otherwise("Normal").alias("label"),
        ),
        labels,
        ",",
    )
    spec = replace(SPECS["HDFS"], catalog=tuple(hdfs_catalog()))
    return load_dataset(spark, spec, log, labels).instances()


@query("""WITH w AS (
  SELECT (row_number() OVER (ORDER BY event_id) - 1) // 120 AS w, value > 200 AS a
  FROM events WHERE event_id % 97 <> 0)
SELECT CAST(w AS VARCHAR) AS session_id, count(*) AS n_events,
  CASE WHEN bool_or(a) THEN 'Anomalous' ELSE 'Normal' END AS label FROM w GROUP BY w""")
def load_spirit_dataset(spark, sf_dir):
    """Registry entry with global windows and mined templates."""
    from workload.fixtures import alert_lines_raw

    log = scratch_path(spark, "log")
    L.write_log_lines(alert_lines_raw(spark, sf_dir), log)
    return load_dataset(spark, SPECS["Spirit"], log).instances()


@query("""WITH w AS (
  SELECT 'node' || user_id || '_' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 120 AS w, value > 200 AS a
  FROM events)
SELECT w AS session_id, count(*) AS n_events,
  CASE WHEN bool_or(a) THEN 'Anomalous' ELSE 'Normal' END AS label FROM w GROUP BY w""")
def load_bgl_dataset(spark, sf_dir):
    """Registry entry with windows per node and loosely mined templates."""
    from workload.fixtures import alert_lines_raw

    log = scratch_path(spark, "log")
    L.write_log_lines(alert_lines_raw(spark, sf_dir), log)
    return load_dataset(spark, SPECS["BGL"], log).instances()
