"""Splits, samples, event indexes and vocabularies."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from logweir.functions.vectors import sum_vectors
from logweir.operators import splits as P
from workload.fixtures import (
    M_SQL, S_SQL, is_train, TRAIN_SQL, V_SQL, sequences, sessions, vectors,
)
from workload.registry import query

_DRAW = int(hashlib.md5(b"6").hexdigest()[:7], 16)

SPLIT_SQL = (
    S_SQL
    + """,
nn AS (SELECT count(*) AS total FROM s),
pool AS (
  SELECT s.*, row_number() OVER (ORDER BY md5('6:' || session_id)) - 1 AS split_idx
  FROM s, nn WHERE session_idx < floor(CAST(0.7 AS DOUBLE) * total)),
sp AS (
  SELECT pool.*, CASE WHEN split_idx >= floor(CAST(0.6 AS DOUBLE) * total) THEN 'dev' ELSE 'train' END
    AS split FROM pool, nn
  UNION ALL
  SELECT s.*, session_idx, 'test' FROM s, nn WHERE session_idx >= floor(CAST(0.7 AS DOUBLE) * total))"""
)


@query(f"WITH {SPLIT_SQL} SELECT session_id, split, split_idx FROM sp")
def split_613(spark, sf_dir):
    return P.split_613(sessions(spark, sf_dir)).select("session_id", "split", "split_idx")


@query(f"""WITH {SPLIT_SQL},
z AS (SELECT floor(CAST(0.6 AS DOUBLE) * total)::BIGINT AS t,
        floor(CAST(0.05 AS DOUBLE) * floor(CAST(0.6 AS DOUBLE) * total))::BIGINT AS size FROM nn),
b AS (SELECT t, size, {_DRAW} % greatest(t - size, 1) AS b FROM z)
SELECT session_id, CASE WHEN split <> 'train' THEN split
  WHEN split_idx >= b AND split_idx < b + size THEN 'train' ELSE 'unused' END AS split
FROM sp, b""")
def split_613_slice(spark, sf_dir):
    return P.split_613(sessions(spark, sf_dir), train_fraction=0.05).select("session_id", "split")


@query(f"""WITH {S_SQL}
SELECT session_id, CASE WHEN row_number() OVER (ORDER BY md5('6:' || session_id)) - 1
  < ceil(CAST(0.8 AS DOUBLE) * (SELECT count(*) FROM s)) THEN 'train' ELSE 'test' END AS split
FROM s""")
def split_82(spark, sf_dir):
    return P.split_82(sessions(spark, sf_dir)).select("session_id", "split")


@query(f"""WITH {SPLIT_SQL}
SELECT split, count(*) FILTER (label = 'Normal') AS normal,
  count(*) FILTER (label = 'Anomalous') AS anomalous FROM sp GROUP BY split""")
def label_distribution(spark, sf_dir):
    return P.label_distribution(P.split_613(sessions(spark, sf_dir)))


@query(f"""WITH {S_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY md5('6:' || session_id)) AS r
  FROM s WHERE label = 'Normal')
SELECT session_id FROM k WHERE r <= floor(CAST(0.5 AS DOUBLE) * (SELECT count(*) FROM k))""")
def sample_normals(spark, sf_dir):
    return P.sample_normals(sessions(spark, sf_dir)).select("session_id")


@query(f"""WITH {S_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY session_idx) AS r
  FROM s WHERE label = 'Normal')
SELECT session_id FROM k WHERE r <= floor(CAST(0.5 AS DOUBLE) * (SELECT count(*) FROM k))""")
def labelled_normals(spark, sf_dir):
    return P.labelled_normals(sessions(spark, sf_dir)).select("session_id")


def _shifted(spark, sf_dir):
    """Train has the events of even users, test those of odd users plus marked ones."""
    seq = sequences(spark, sf_dir)
    train = seq.filter(is_train())
    marked = F.when(F.col("pos") == 9, F.concat("event", F.lit("_late"))).otherwise(F.col("event"))
    return train, seq.filter(~is_train()).withColumn("event", marked)


SHIFTED_SQL = f"""{M_SQL},
tr AS (SELECT session_id, pos, log_id, event_key AS event FROM m WHERE {TRAIN_SQL}),
te AS (SELECT session_id, pos, CASE WHEN pos = 9 THEN event_key || '_late' ELSE event_key END AS event
       FROM m WHERE NOT ({TRAIN_SQL})),
ix AS (
  SELECT event, row_number() OVER (ORDER BY part, event) - 1 AS idx FROM (
    SELECT DISTINCT 0 AS part, event FROM tr UNION ALL
    SELECT DISTINCT 1 AS part, event FROM te WHERE event NOT IN (SELECT event FROM tr)))"""


@query(f"WITH {SHIFTED_SQL} SELECT DISTINCT event FROM te")
def event_vocabulary(spark, sf_dir):
    return P.event_vocabulary(_shifted(spark, sf_dir)[1])


@query(f"WITH {SHIFTED_SQL} SELECT event, idx FROM ix")
def event_index(spark, sf_dir):
    return P.event_index(*_shifted(spark, sf_dir))


@query(f"""WITH {SHIFTED_SQL}, f AS (SELECT event, min(log_id) AS f FROM tr GROUP BY event)
SELECT event, row_number() OVER (ORDER BY f) - 1 AS idx FROM f""")
def event_index_first_seen(spark, sf_dir):
    train, _ = _shifted(spark, sf_dir)
    lines = sequences(spark, sf_dir, "log_id").withColumnRenamed("event", "session_idx")
    return P.event_index(train.join(lines, ["session_id", "pos"]), order="first_seen")


@query(f"""WITH {SHIFTED_SQL}, k AS (SELECT DISTINCT event FROM tr),
c AS (SELECT event, row_number() OVER (ORDER BY event) - 1 AS idx FROM k)
SELECT session_id, pos, CAST(coalesce(idx, (SELECT count(*) FROM c)) AS INT) AS code
FROM te LEFT JOIN c ON te.event = c.event""")
def encode_sequences(spark, sf_dir):
    train, test = _shifted(spark, sf_dir)
    return P.encode_sequences(test, P.event_index(train))


@query(f"""WITH {V_SQL}, t AS (SELECT dim, sum(x) / (count(*) + 4) AS x FROM v GROUP BY dim)
SELECT dim, round(x, 6) + 0.0 AS unk_value FROM t""")
def vocabulary_unk(spark, sf_dir):
    words = vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("token"), "vec")
    unk = P.build_vocabulary(words).filter(F.col("token") == "<oov>")
    return unk.select(F.posexplode("vec").alias("dim", "x")).select(
        F.col("dim").cast("bigint").alias("dim"), (F.round("x", 6) + 0.0).alias("unk_value")
    )
