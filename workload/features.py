"""Count, tf-idf, OOV, token and semantic features, sliding windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.operators import features as X
from logweir.operators import windows as G
from workload.fixtures import (
    EV_SQL, M_SQL, is_train, TRAIN_SQL, V_SQL, documents, event_vectors, sequences, table, vectors, word_vectors,
)
from workload.registry import query
from workload.splits import SHIFTED_SQL, _shifted
from workload.text import CUTS_SQL, TOKENS_SQL


def r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


C_SQL = (
    M_SQL
    + """,
c AS (SELECT session_id, event_key AS event, count(*) AS cnt FROM m GROUP BY 1, 2),
nn AS (SELECT count(DISTINCT session_id) AS n FROM m),
i AS (SELECT event, count(*) AS df, ln(any_value(n) / (count(*) + CAST(1e-8 AS DOUBLE))) AS idf
      FROM c, nn GROUP BY event),
w AS (SELECT session_id, c.event, cnt * idf AS x FROM c JOIN i ON c.event = i.event)"""
)


@query(f"WITH {C_SQL} SELECT session_id, event, cnt FROM c")
def event_counts(spark, sf_dir):
    return X.event_counts(sequences(spark, sf_dir))


@query(f"WITH {C_SQL} SELECT event, df, round(idf, 6) + 0.0 AS idf FROM i")
def idf(spark, sf_dir):
    out = X.fit_idf(X.event_counts(sequences(spark, sf_dir)))
    return out.select("event", "df", r("idf").alias("idf"))


@query(f"WITH {C_SQL} SELECT session_id, event, round(x, 6) + 0.0 AS weight FROM w")
def tfidf(spark, sf_dir):
    counts = X.event_counts(sequences(spark, sf_dir))
    out = X.tfidf(counts, X.fit_idf(counts))
    return out.select("session_id", "event", r("x").alias("weight"))


@query(f"""WITH {C_SQL}, mu AS (SELECT event, sum(x) / any_value(n) AS mean FROM w, nn GROUP BY event)
SELECT q.session_id, mu.event, round(coalesce(w.x, 0) - mean, 6) + 0.0 AS x
FROM (SELECT DISTINCT session_id FROM m) q CROSS JOIN mu
LEFT JOIN w ON w.session_id = q.session_id AND w.event = mu.event""")
def zero_mean(spark, sf_dir):
    seq = sequences(spark, sf_dir)
    model = X.CountModel.fit(seq, "tf-idf", "zero-mean")
    return model.transform(seq).select("session_id", "event", r("x").alias("x"))


@query(f"""WITH {C_SQL}
SELECT session_id, event, round(CASE WHEN x <> 0 THEN 1 / (1 + exp(-x)) ELSE x END, 6) + 0.0 AS x
FROM w""")
def sigmoid_weights(spark, sf_dir):
    seq = sequences(spark, sf_dir)
    model = X.CountModel.fit(seq, "tf-idf", "sigmoid")
    return model.transform(seq).select("session_id", "event", r("x").alias("x"))


@query(f"""WITH {C_SQL},
keep AS (SELECT event FROM c GROUP BY event HAVING count(*) >= 300)
SELECT session_id, event, cnt FROM c WHERE event IN (SELECT event FROM keep)
UNION ALL SELECT session_id, '<oov>', count(*) FROM c WHERE event NOT IN (SELECT event FROM keep)
GROUP BY session_id""".replace("300", "(SELECT n / 5 FROM nn)"))
def rare_event_oov(spark, sf_dir):
    """Events found in fewer than a fifth of the sessions are folded."""
    counts = X.event_counts(sequences(spark, sf_dir))
    limit = X.session_count(counts) / 5
    keep = (
        counts.groupBy("event").agg(F.count("*").alias("df"))
        .filter(F.col("df") >= limit).select("event")
    )
    return X.fold_unseen(counts, keep, oov=True)


@query(f"""WITH {SHIFTED_SQL},
tc AS (SELECT session_id, event, count(*) AS cnt FROM te GROUP BY 1, 2),
ti AS (SELECT event, ln((SELECT count(DISTINCT session_id) FROM tr)
         / (count(DISTINCT session_id) + CAST(1e-8 AS DOUBLE))) AS idf FROM tr GROUP BY event)
SELECT session_id, tc.event, round(cnt * idf, 6) + 0.0 AS x FROM tc JOIN ti ON tc.event = ti.event""")
def transform_unseen(spark, sf_dir):
    """Train vocabulary on the test sessions; unseen events go."""
    train, test = _shifted(spark, sf_dir)
    return X.CountModel.fit(train, "tf-idf").transform(test).select(
        "session_id", "event", r("x").alias("x")
    )


@query(f"""WITH {SHIFTED_SQL}, tc AS (SELECT session_id, event, count(*) AS cnt FROM te GROUP BY 1, 2)
SELECT session_id, event, CAST(cnt AS DOUBLE) AS x FROM tc WHERE event IN (SELECT event FROM tr)
UNION ALL SELECT session_id, '<oov>', CAST(count(*) AS DOUBLE) FROM tc
WHERE event NOT IN (SELECT event FROM tr) GROUP BY session_id""")
def transform_unseen_oov(spark, sf_dir):
    """Train vocabulary on the test sessions; distinct unseen events are counted."""
    train, test = _shifted(spark, sf_dir)
    return X.CountModel.fit(train, oov=True).transform(test)


@query(f"""WITH {SHIFTED_SQL},
trc AS (SELECT session_id, event, count(*) AS cnt FROM tr GROUP BY 1, 2),
keep AS (SELECT event FROM trc GROUP BY event HAVING count(*) >= 2),
trf AS (SELECT session_id, event, cnt FROM trc WHERE event IN (SELECT event FROM keep)
  UNION ALL SELECT session_id, '<oov>', count(*) FROM trc WHERE event NOT IN (SELECT event FROM keep) GROUP BY 1),
dfs AS (SELECT event, count(*) AS df FROM trf GROUP BY event
  UNION ALL SELECT '<oov>', 0 WHERE NOT EXISTS (SELECT 1 FROM trf WHERE event = '<oov>')),
ti AS (SELECT event, ln((SELECT count(DISTINCT session_id) FROM tr) / (df + CAST(1e-8 AS DOUBLE))) AS idf FROM dfs),
tc AS (SELECT session_id, event, count(*) AS cnt FROM te GROUP BY 1, 2),
tf AS (SELECT session_id, event, cnt FROM tc WHERE event IN (SELECT event FROM keep)
  UNION ALL SELECT session_id, '<oov>', count(*) FROM tc WHERE event NOT IN (SELECT event FROM keep) GROUP BY 1)
SELECT session_id, event, round(cnt * idf, 6) + 0.0 AS x FROM tf JOIN ti USING (event)""")
def tfidf_oov(spark, sf_dir):
    """Fitted tf-idf with folded rare events; unseen events count as `<oov>` in any case."""
    train, test = _shifted(spark, sf_dir)
    out = X.CountModel.fit(train, "tf-idf", oov=True, min_count=2).transform(test)
    return out.select("session_id", "event", r("x").alias("x"))


def _templates(spark, sf_dir):
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("template_id"), F.col("text").alias("template")
    )


T_SQL = f"""
t AS (SELECT doc_id AS template_id, {TOKENS_SQL.format('text')} AS toks FROM documents),
tt AS (SELECT template_id, len(toks) AS n, unnest(toks) AS token FROM t),
ti AS (SELECT token, count(*) AS cnt, ln((SELECT count(*) FROM t) / count(*)) AS idf
       FROM tt GROUP BY token)"""


@query(f"WITH {T_SQL} SELECT token, cnt, round(idf, 6) + 0.0 AS idf FROM ti")
def token_idf(spark, sf_dir):
    return X.token_idf(_templates(spark, sf_dir)).select("token", "cnt", r("idf").alias("idf"))


P_SQL = (
    T_SQL
    + f""",
sw AS (SELECT token, word, count(*) AS times
       FROM (SELECT token, unnest(string_split(lower({CUTS_SQL}), ' ')) AS word FROM (SELECT DISTINCT token FROM tt))
       WHERE trim(word) <> '' GROUP BY 1, 2),
nw AS (SELECT token, sum(times) AS n_words FROM sw GROUP BY token),
wd AS (SELECT word, CAST('0x' || substr(md5(word), 1, 7) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id
       FROM (SELECT DISTINCT word FROM sw) WHERE NOT regexp_matches(word, '^[aeiou]')),"""
    + V_SQL
    + """,
wv AS (SELECT token, dim, sum(times * x) / any_value(n_words) AS x
       FROM sw JOIN nw USING (token) JOIN wd USING (word) JOIN v USING (vec_id) GROUP BY 1, 2)"""
)


@query(f"""WITH {P_SQL} SELECT token, round(sum(x), 5) + 0.0 AS total, round(sum(x * x), 5) AS squares
FROM wv GROUP BY token""")
def word_vectors_mean(spark, sf_dir):
    tokens = X.token_counts(_templates(spark, sf_dir))
    out = X.word_vectors_mean(tokens, word_vectors(spark, sf_dir))
    add = lambda acc, x: acc + x
    return out.select(
        "token",
        r(F.aggregate("vec", F.lit(0.0), add), 5).alias("total"),
        F.round(F.aggregate(F.transform("vec", lambda x: x * x), F.lit(0.0), add), 5).alias("squares"),
    )


@query(f"""WITH {P_SQL},
tc AS (SELECT template_id, token, n, count(*) AS c FROM tt GROUP BY 1, 2, 3),
sums AS (SELECT template_id, dim, sum(c * c / n * idf * x) AS x
         FROM tc JOIN ti USING (token) JOIN wv USING (token) GROUP BY 1, 2)
SELECT t.template_id, dims.dim, round(coalesce(x, 0), 5) + 0.0 AS x
FROM t CROSS JOIN (SELECT unnest(range(64)) AS dim) dims
LEFT JOIN sums ON sums.template_id = t.template_id AND sums.dim = dims.dim""")
def template_vectors(spark, sf_dir):
    out = X.template_vectors(_templates(spark, sf_dir), word_vectors(spark, sf_dir))
    return out.select("template_id", F.posexplode("vec").alias("dim", "x")).select(
        "template_id", F.col("dim").cast("bigint").alias("dim"), r("x", 5).alias("x")
    )


@query(f"""WITH {P_SQL}
SELECT coalesce(sum(times) FILTER (wd.word IS NULL), 0)::BIGINT AS missing, sum(times)::BIGINT AS total
FROM tt JOIN sw USING (token) LEFT JOIN wd ON wd.word = sw.word""")
def oov_rate(spark, sf_dir):
    return X.oov_rate(_templates(spark, sf_dir), word_vectors(spark, sf_dir))


@query(f"""WITH {M_SQL}, {EV_SQL}
SELECT session_id, dim, round(sum(x), 5) + 0.0 AS x FROM m JOIN ev ON event_key = event GROUP BY 1, 2""")
def sequence_vectors(spark, sf_dir):
    out = X.sequence_vectors(sequences(spark, sf_dir), event_vectors(spark, sf_dir))
    return out.select("session_id", F.posexplode("vec").alias("dim", "x")).select(
        "session_id", F.col("dim").cast("bigint").alias("dim"), r("x", 5).alias("x")
    )


@query(f"WITH {V_SQL} SELECT dim, round(avg(x), 6) + 0.0 AS x FROM v GROUP BY dim")
def mean_vector(spark, sf_dir):
    out = X.mean_vector(vectors(spark, sf_dir))
    return out.select(F.posexplode("vec").alias("dim", "x")).select(
        F.col("dim").cast("bigint").alias("dim"), r("x").alias("x")
    )


# ---- windows ---------------------------------------------------------------------------


def user_sequences(spark, sf_dir):
    """One long sequence of event types per user."""
    from logweir.operators.ranks import key_index
    from workload.fixtures import event_lines

    lines = event_lines(spark, sf_dir).select(
        F.col("node").alias("session_id"), "log_id", F.col("event_type").alias("event")
    )
    return key_index(lines, "session_id", "log_id").select("session_id", "pos", "event")


U_SQL = """
u AS (SELECT user_id AS session_id, event_type AS event,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)"""


def windows_sql(h: int, source: str = "u") -> str:
    parts = ", ".join(f"lead(event, {i}) OVER q" for i in range(h))
    return f"""wn AS (
  SELECT session_id, pos, array_to_string([{parts}], ' ') AS win, lead(event, {h}) OVER q AS next_event
  FROM {source} WINDOW q AS (PARTITION BY session_id ORDER BY pos) QUALIFY next_event IS NOT NULL)"""


@query(f'WITH {U_SQL}, {windows_sql(10)} SELECT session_id, pos, win AS "window", next_event FROM wn')
def sliding_windows(spark, sf_dir):
    out = G.sliding_windows(user_sequences(spark, sf_dir), 10)
    return out.withColumn("window", F.array_join("window", " "))


@query(f"""WITH {U_SQL}, {windows_sql(3)}
SELECT session_id, pos, win AS "window", next_event FROM wn WHERE pos % 2 = 0""")
def sliding_windows_step(spark, sf_dir):
    out = G.sliding_windows(user_sequences(spark, sf_dir), 3, step=2, block=16)
    return out.withColumn("window", F.array_join("window", " "))


@query("""SELECT l_orderkey AS session_id, count(*) AS n FROM lineitem
GROUP BY l_orderkey HAVING count(*) <= 3""")
def short_sessions(spark, sf_dir):
    seq = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"))
    return G.short_sessions(seq, 3)


@query(f"""WITH {U_SQL}, {windows_sql(3)}
SELECT win AS "window", next_event, count(*) AS n FROM wn GROUP BY 1, 2""")
def distinct_windows(spark, sf_dir):
    out = G.distinct_windows(G.sliding_windows(user_sequences(spark, sf_dir), 3))
    return out.withColumn("window", F.array_join("window", " "))


@query(f"""WITH {U_SQL}, {windows_sql(10)}, dw AS (SELECT DISTINCT win FROM wn),
x AS (SELECT win, unnest(string_split(win, ' ')) AS event FROM dw)
SELECT win AS "window", event, count(*) AS cnt FROM x GROUP BY 1, 2""")
def window_counts(spark, sf_dir):
    out = G.window_counts(G.sliding_windows(user_sequences(spark, sf_dir), 10))
    return out.withColumn("window", F.array_join("window", " "))


@query(f"""WITH {U_SQL} SELECT session_id, least(count(*), 50) AS n,
  string_agg(event, ' ' ORDER BY pos) FILTER (WHERE pos < 50) AS events FROM u GROUP BY 1""")
def truncate_sequences(spark, sf_dir):
    out = G.event_arrays(user_sequences(spark, sf_dir), 50)
    return out.select(
        "session_id", F.size("events").cast("bigint").alias("n"),
        F.array_join("events", " ").alias("events"),
    )


@query("""WITH o AS (SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ' '
    ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq_key FROM lineitem GROUP BY 1)
SELECT seq_key, count(*) AS n FROM o GROUP BY 1""")
def distinct_sequences(spark, sf_dir):
    from logweir.operators.ranks import key_index

    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), "l_linenumber", "l_partkey", "l_suppkey",
        F.concat("l_returnflag", "l_linestatus").alias("event"),
    )
    seq = key_index(lines, "session_id", "l_linenumber", ["l_partkey", "l_suppkey"])
    text = seq.groupBy("session_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "event")))["event"], " ").alias("text")
    )
    same = G.sequence_keys(seq).join(text, "session_id").groupBy("seq_key")
    return same.agg(F.min("text").alias("text"), F.count("*").alias("n")).select(
        F.col("text").alias("seq_key"), "n"
    )
