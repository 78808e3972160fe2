"""Sessions, sequences and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.functions import text as T
from logweir.operators import sessions as S
from logweir.session import materialise
from workload.fixtures import L_SQL, M_SQL, event_lines, raw_lines, table
from workload.registry import query
from workload.text import MIXED_SQL, _mixed_lines


@query(f"""WITH {MIXED_SQL},
first AS (SELECT k.key, min(k.log_id) AS f FROM k GROUP BY k.key),
o AS (SELECT first.key, f, instr(CASE WHEN instr(message, first.key) > 0 THEN message ELSE raw END,
        first.key) AS place FROM first JOIN y ON y.log_id = f),
i AS (SELECT key, f, row_number() OVER (ORDER BY f, place) - 1 AS session_idx FROM o)
SELECT k.key AS session_id, session_idx,
       row_number() OVER (PARTITION BY k.key ORDER BY log_id) - 1 AS pos, log_id
FROM k JOIN i ON k.key = i.key""")
def sessions_by_block(spark, sf_dir):
    lines = _mixed_lines(spark, sf_dir)
    members = materialise(S.sessions_by_key(lines), "members")   # read three times
    from logweir.operators.ranks import key_index

    return key_index(members, "session_id", "log_id").join(
        S.session_index(members), "session_id"
    ).select("session_id", "session_idx", "pos", "log_id")


@query(f"""WITH {L_SQL},
e AS (SELECT log_id, regexp_extract(raw, 'blk_[0-9]+') AS session_id, CASE event_type
        WHEN 'click' THEN 4 WHEN 'view' THEN 2 WHEN 'purchase' THEN 8 ELSE 25 END AS event
      FROM l WHERE event_type <> 'error')
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY log_id) - 1 AS pos, event
FROM e""")
def event_sequences(spark, sf_dir):
    """Members of block sessions joined to their templates; `error` lines have none."""
    from logweir.operators.templates import hdfs_catalog, match_templates

    lines = raw_lines(spark, sf_dir).withColumn("message", T.drop_columns("raw", range(5)))
    catalog = [t for t in hdfs_catalog() if not t[1].startswith("writeBlock")]
    matched = match_templates(lines, catalog).filter(F.col("template_id").isNotNull())
    return S.event_sequences(S.sessions_by_key(lines), matched).withColumn(
        "event", F.col("event").cast("int")
    )


@query(f"""WITH {M_SQL} SELECT session_id, count(*) AS n,
  CASE WHEN bool_or(is_alert) THEN 'Anomalous' ELSE 'Normal' END AS label
FROM m GROUP BY session_id""")
def sessions_by_node_count(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return S.label_any(S.sessions_by_count(lines, 10, partition_by="node"))


@query("""WITH w AS (
  SELECT (row_number() OVER (ORDER BY event_id) - 1) // 120 AS w,
         (row_number() OVER (ORDER BY event_id) - 1) % 120 AS pos, value > 200 AS a
  FROM events WHERE event_id % 97 <> 0)
SELECT CAST(w AS VARCHAR) AS session_id, count(*) AS n,
  CASE WHEN bool_or(a) THEN 'Anomalous' ELSE 'Normal' END AS label,
  CASE WHEN bool_or(a AND (w = 0 OR pos > 0)) THEN 'Anomalous' ELSE 'Normal' END AS label_skip_first
FROM w GROUP BY w""")
def sessions_by_global_count(spark, sf_dir):
    """Windows over valid lines only; ids of dropped lines stay used."""
    from workload.fixtures import alert_lines_raw

    valid = T.parse_header(alert_lines_raw(spark, sf_dir), strict_ts=True)
    members = S.sessions_by_count(valid.select("log_id", "is_alert"), 120)
    skip = S.label_any(members, skip_first=True).select(
        "session_id", F.col("label").alias("label_skip_first")
    )
    return S.label_any(members).join(skip, "session_id")


@query("""SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, count(*) AS n,
  CASE WHEN bool_or(value > 200) THEN 'Anomalous' ELSE 'Normal' END AS label
FROM events GROUP BY 1""")
def sessions_by_hour(spark, sf_dir):
    members = S.sessions_by_time(event_lines(spark, sf_dir), 3600)
    return S.label_any(members, keys=("window_start",))


@query("""SELECT user_id AS node, epoch(date_trunc('day', ts))::BIGINT AS window_start,
  count(*) AS n, CASE WHEN bool_or(value > 200) THEN 'Anomalous' ELSE 'Normal' END AS label
FROM events GROUP BY 1, 2""")
def sessions_by_node_day(spark, sf_dir):
    members = S.sessions_by_time(event_lines(spark, sf_dir), 86400, partition_by="node")
    return S.label_any(members, keys=("node", "window_start"))


def _doc_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id"), S.label_of(F.col("toxic") == 1).alias("label")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs, labels


@query("""SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'Anomalous' ELSE 'Normal' END AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def attach_labels(spark, sf_dir):
    docs, labels = _doc_labels(spark, sf_dir)
    return S.attach_labels(docs, labels, "doc_id")


@query("""SELECT doc_id, 'no_label' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL
SELECT doc_id, 'no_events' FROM (SELECT DISTINCT doc_id FROM labels)
WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def label_mismatches(spark, sf_dir):
    docs, labels = _doc_labels(spark, sf_dir)
    return S.label_mismatches(docs, labels, "doc_id")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS session_id, count(*) AS n_events,
  CASE WHEN o_orderstatus = 'F' THEN 'Anomalous' ELSE 'Normal' END AS label
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus""")
def instances(spark, sf_dir):
    """Unsplit instances: order lines are the events, the order gives the label."""
    seq = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("session_id"), "l_linenumber"
    )
    labels = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("session_id"),
        S.label_of(F.col("o_orderstatus") == "F").alias("label"),
    )
    sizes = seq.groupBy("session_id").agg(F.count("*").alias("n_events"))
    return S.attach_labels(sizes, labels)
