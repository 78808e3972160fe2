"""Log-shaped views of the given tables, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.functions.columns import explode_once
from logweir.operators.sessions import label_any, session_index, sessions_by_count
from logweir.session import materialise, spread

ALERT_VALUE = 200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- sessions: ten events of a user ------------------------------------------------


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, ts, node, event, event_key, is_alert): one line per event."""
    bucket = F.floor(F.least(F.col("value"), F.lit(199.0)) / 25).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        "ts",
        F.col("user_id").alias("node"),
        F.col("event_type").alias("event_type"),
        F.concat_ws("_", "event_type", bucket).alias("event_key"),
        (F.col("value") > ALERT_VALUE).alias("is_alert"),
    )


def members(spark: SparkSession, sf_dir: str, size: int = 10) -> DataFrame:
    return sessions_by_count(event_lines(spark, sf_dir), size, partition_by="node")


def sequences(spark: SparkSession, sf_dir: str, event: str = "event_key") -> DataFrame:
    return members(spark, sf_dir).select("session_id", "pos", F.col(event).alias("event"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, session_idx, n, label)."""
    m = members(spark, sf_dir)
    return (
        label_any(m)
        .join(session_index(m), "session_id")
        .select("session_id", "session_idx", "n", "label")
    )


M_SQL = """
m AS (
  SELECT event_id AS log_id, ts, user_id AS node, event_type, value > 200 AS is_alert,
         event_type || '_' || CAST(CAST(floor(least(value, 199) / 25) AS BIGINT) AS VARCHAR)
           AS event_key,
         CAST(user_id AS VARCHAR) || '_' || CAST((row_number() OVER
           (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS VARCHAR) AS session_id,
         (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 10 AS pos
  FROM events)"""

S_SQL = (
    M_SQL
    + """,
s AS (
  SELECT session_id, n, label, row_number() OVER (ORDER BY f) - 1 AS session_idx
  FROM (SELECT session_id, count(*) AS n, min(log_id) AS f,
               CASE WHEN bool_or(is_alert) THEN 'Anomalous' ELSE 'Normal' END AS label
        FROM m GROUP BY session_id))"""
)

# train = the sessions whose user is even, test = the rest
def is_train():
    return (F.substring_index("session_id", "_", 1).cast("bigint") % 2) == 0


TRAIN_SQL = "CAST(split_part(session_id, '_', 1) AS BIGINT) % 2 = 0"


# ---- rendered raw lines ---------------------------------------------------------------


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, raw): block-store log lines with five header tokens."""
    e = F.col("event_id").cast("string")
    u = F.col("user_id").cast("string")
    ip = F.concat(F.lit("10.0."), (F.col("event_id") % 250).cast("string"))
    message = (
        F.when(
            F.col("event_type") == "click",
            F.concat(
                F.lit("Receiving block blk_"), u, F.lit(" src: /"), ip, F.lit(".1:50010 dest: /"),
                ip, F.lit(".2:50010"),
            ),
        )
        .when(
            F.col("event_type") == "view",
            F.concat(ip, F.lit(".1:50010 Served block blk_"), u, F.lit(" to /"), ip, F.lit(".2")),
        )
        .when(
            F.col("event_type") == "purchase",
            F.concat(
                F.lit("Received block blk_"), u, F.lit(" of size "), e, F.lit(" from /"), ip,
                F.lit(".1"),
            ),
        )
        .when(
            F.col("event_type") == "signup",
            F.concat(
                F.lit("BLOCK* NameSystem.addStoredBlock: blockMap updated: "), ip,
                F.lit(".1:50010 is added to blk_"), u, F.lit(" size "), e,
            ),
        )
        .otherwise(
            F.concat(
                F.lit("writeBlock blk_"), u,
                F.lit(" received exception java.io.IOException: Could not read from stream"),
            )
        )
    )
    head = F.concat(F.lit("081109 203518 "), e, F.lit(" INFO dfs.DataNode: "))
    return spread(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("log_id"), F.concat(head, message).alias("raw")
    )


L_SQL = """
l0 AS (
  SELECT event_id, event_type, value, CAST(event_id AS VARCHAR) AS e,
         CAST(user_id AS VARCHAR) AS u, '10.0.' || CAST(event_id % 250 AS VARCHAR) AS ip
  FROM events),
l AS (
  SELECT event_id AS log_id, event_type, '081109 203518 ' || e || ' INFO dfs.DataNode: ' || CASE event_type
    WHEN 'click' THEN 'Receiving block blk_' || u || ' src: /' || ip || '.1:50010 dest: /'
      || ip || '.2:50010'
    WHEN 'view' THEN ip || '.1:50010 Served block blk_' || u || ' to /' || ip || '.2'
    WHEN 'purchase' THEN 'Received block blk_' || u || ' of size ' || e || ' from /' || ip || '.1'
    WHEN 'signup' THEN 'BLOCK* NameSystem.addStoredBlock: blockMap updated: ' || ip
      || '.1:50010 is added to blk_' || u || ' size ' || e
    ELSE 'writeBlock blk_' || u || ' received exception java.io.IOException: '
      || 'Could not read from stream' END AS raw
  FROM l0)"""


def alert_lines_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, raw): the same kind of lines with nine alert-style header tokens.

    Every 97th line has a broken time token.
    """
    e = F.col("event_id")
    sec = e % 86400
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    clock = F.concat_ws(
        ":", two(F.floor(sec / 3600)), two(F.floor(sec / 60) % 60), two(sec % 60)
    )
    clock = F.when(e % 97 == 0, F.lit("99:99:99")).otherwise(clock)
    flag = F.when(F.col("value") > ALERT_VALUE, F.lit("ALERT")).otherwise(F.lit("-"))
    return spread(table(spark, sf_dir, "events")).select(
        e.alias("log_id"),
        F.concat_ws(
            " ", flag, e.cast("string"), F.lit("2005.01.01"),
            F.concat(F.lit("node"), F.col("user_id").cast("string")), F.lit("x x"), clock,
            F.lit("x x"), F.col("event_type"), F.lit("at /var/log/x.log from 10.0.0.1"),
        ).alias("raw"),
    )


A_SQL = """
a AS (
  SELECT event_id AS log_id, value > 200 AS alert, user_id, event_id % 86400 AS sec,
         event_id % 97 = 0 AS broken, event_type
  FROM events)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


# ---- document lines -------------------------------------------------------------------


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, raw): the lines of all documents in document order."""
    return documents(spark, sf_dir).select(
        "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "raw")
    ).select((F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("log_id"), "raw")


D_SQL = """
d AS (
  SELECT doc_id * 1000000 + unnest(range(len(parts))) AS log_id, unnest(parts) AS raw
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""

WS_SQL = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}]"
)


def tokens_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '{WS_SQL}+'), lambda x: x <> '')"


# ---- vectors --------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, vec, label) of the embedding table as doubles."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, vec): the camel words of the documents; a word takes the vector its md5 names.

    Words that start with a vowel stay without a vector.
    """
    from logweir.functions.text import camel_words, template_tokens

    n = table(spark, sf_dir, "embeddings").agg(F.count("*")).scalar()
    tokens = explode_once(documents(spark, sf_dir), name="t", values=template_tokens("text")).distinct()
    words = (
        explode_once(tokens, name="token", values=camel_words("t"))
        .filter(~F.col("token").rlike("^[aeiou]"))
        .distinct()
        .withColumn("vec_id", F.conv(F.substring(F.md5("token"), 1, 7), 16, 10).cast("bigint") % n)
    )
    found = words.join(vectors(spark, sf_dir), "vec_id").select("token", "vec")
    return materialise(found, "word-vectors")


def event_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event, vec): vector i for the i-th event key."""
    from logweir.operators.splits import event_index

    index = event_index(event_lines(spark, sf_dir).select(F.col("event_key").alias("event")))
    found = index.join(vectors(spark, sf_dir), F.col("idx") == F.col("vec_id"))
    return materialise(found.select("event", "vec"), "event-vectors")


V_SQL = """
v AS (
  SELECT vec_id, label, dim, CAST(embedding[dim + 1] AS DOUBLE) AS x
  FROM embeddings, range(64) AS r(dim))"""

EV_SQL = (
    V_SQL
    + """,
ev AS (
  SELECT event, dim, x
  FROM (SELECT event_key AS event, row_number() OVER (ORDER BY event_key) - 1 AS idx
        FROM (SELECT DISTINCT event_key FROM m)) JOIN v ON vec_id = idx)"""
)
