"""Confusion counts, scores and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.operators import evaluate as E
from logweir.operators.sessions import label_of
from logweir.operators.windows import sequence_keys
from logweir.session import materialise
from workload.detectors import (
    NEAR_SQL, PU_SQL, RANKED_SQL, _labels, _model, conformance_flags, pu,
)
from workload.features import r
from workload.fixtures import is_train, sequences, table, vectors
from workload.registry import query

CF_SQL = f"""{RANKED_SQL},
f AS (SELECT session_id, label, CASE WHEN worst > 20 THEN 'Anomalous' ELSE 'Normal' END AS predicted
      FROM worst)"""


def counts_sql(source: str, weight: str = "1", where: str = "TRUE") -> str:
    arm = lambda l, p: f"coalesce(sum({weight}) FILTER (label = '{l}' AND predicted = '{p}'), 0)::BIGINT"  # noqa: E731,E741
    return (
        f"SELECT {arm('Anomalous', 'Anomalous')} AS tp, {arm('Normal', 'Normal')} AS tn, "
        f"{arm('Normal', 'Anomalous')} AS fp, {arm('Anomalous', 'Normal')} AS fn "
        f"FROM {source} WHERE {where}"
    )


def prf_sql(scale: int = 1) -> str:
    return (
        f"SELECT *, round(CASE WHEN tp > 0 THEN {scale} * tp / (tp + fp) ELSE 0 END, 6) + 0.0 AS precision, "
        f"round(CASE WHEN tp > 0 THEN {scale} * tp / (tp + fn) ELSE 0 END, 6) + 0.0 AS recall, "
        f"round(CASE WHEN tp > 0 THEN {scale} * 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) + 0.0 AS f1 FROM k"
    )


def _rounded(df):
    return df.select(
        "tp", "tn", "fp", "fn", *[r(c).alias(c) for c in ("precision", "recall", "f1")]
    )


@query(f"WITH {CF_SQL} {counts_sql('f')}")
def confusion(spark, sf_dir):
    return E.confusion(conformance_flags(spark, sf_dir))


@query(f"WITH {CF_SQL}, k AS ({counts_sql('f')}) {prf_sql()}")
def prf(spark, sf_dir):
    return _rounded(E.prf(E.confusion(conformance_flags(spark, sf_dir))))


@query(f"WITH {CF_SQL}, k AS ({counts_sql('f')}) {prf_sql()}")
def next_event_plan(spark, sf_dir):
    """Fit, save, load and evaluate on distinct sequences with their multiplicity."""
    from logweir import models
    from logweir.plans.next_events import NextEventDetector
    from logweir.session import scratch_path

    seq = materialise(sequences(spark, sf_dir), "sequences")
    labels = materialise(_labels(spark, sf_dir), "labels")
    fitted = NextEventDetector.fit(seq.filter(is_train()), labels, h=2, candidates=20, backoff=False)
    path = scratch_path(spark, "model")
    models.save(spark, fitted, path)
    return _rounded(models.load(spark, path).evaluate(seq, labels))


@query(f"WITH {CF_SQL}, k AS ({counts_sql('f')}) {prf_sql(100)}")
def prf_percent(spark, sf_dir):
    return _rounded(E.prf(E.confusion(conformance_flags(spark, sf_dir)), scale=100.0))


@query(f"WITH {CF_SQL} {counts_sql('f', where='''session_id NOT LIKE '%\\_0' ESCAPE '\\' ''')}")
def confusion_excluding(spark, sf_dir):
    """Without the first session of every user."""
    flags = conformance_flags(spark, sf_dir)
    first = flags.filter(F.col("session_id").endswith("_0")).select("session_id")
    return E.confusion(flags, exclude=first)


@query(f"""WITH o AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
f AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'Anomalous' ELSE 'Normal' END AS label,
        CASE WHEN n <= 3 THEN 'Anomalous' ELSE 'Normal' END AS predicted
      FROM o JOIN orders ON o_orderkey = l_orderkey)
{counts_sql('f')}""")
def weighted_confusion(spark, sf_dir):
    """Distinct order sequences are judged once (short ones flagged) and weighted."""
    from logweir.operators.ranks import key_index

    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), "l_linenumber", "l_partkey", "l_suppkey",
        F.concat("l_returnflag", "l_linestatus").alias("event"),
    )
    seq = key_index(lines, "session_id", "l_linenumber", ["l_partkey", "l_suppkey"])
    labels = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        label_of(F.col("o_orderstatus") == "F").alias("label"),
    )
    distinct = (
        sequence_keys(seq).join(labels, "session_id")
        .groupBy("seq_key", "n", "label").agg(F.count("*").alias("times"))
        .withColumn("predicted", E.verdict(F.col("n") <= 3))
    )
    return E.confusion(distinct, weight="times")


SCORES_SQL = f"""{NEAR_SQL},
sc AS (SELECT dist AS score, CASE WHEN label >= 7 THEN 'Anomalous' ELSE 'Normal' END AS label
       FROM near JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id))"""


def _scores(spark, sf_dir):
    near = _model(spark, sf_dir).transform(vectors(spark, sf_dir))
    return near.select(
        F.col("dist").alias("score"), label_of(F.col("label") >= 7).alias("label")
    )


def _sweep_sql(step: str, n: int) -> str:
    return f"""g AS (SELECT i, i * CAST({step} AS DOUBLE) AS threshold FROM range({n}) AS t(i)),
t AS (SELECT i, threshold, count(*) FILTER (score > threshold AND label = 'Anomalous') AS tp,
        count(*) FILTER (score > threshold AND label = 'Normal') AS fp,
        count(*) FILTER (score <= threshold AND label = 'Anomalous') AS fn FROM g, sc GROUP BY 1, 2),
ff AS (SELECT i, threshold, tp, fp, fn,
        CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM t)"""


@query(f"""WITH {SCORES_SQL}, {_sweep_sql('0.1', 11)}
SELECT i, round(threshold, 6) AS threshold, tp, fp, fn, round(f1, 6) + 0.0 AS f1 FROM ff""")
def threshold_sweep(spark, sf_dir):
    swept = E.sweep(_scores(spark, sf_dir), 0.0, 0.1, 11)
    return swept.withColumn("threshold", F.round("threshold", 6)).withColumn("f1", r("f1"))


@query(f"""WITH {SCORES_SQL}, {_sweep_sql('0.000005', 100001)}
SELECT round(threshold, 6) + 0.0 AS threshold, round(f1, 6) + 0.0 AS f1 FROM ff ORDER BY ff.f1 DESC, i LIMIT 1""")
def best_threshold(spark, sf_dir):
    best = E.best_threshold(E.sweep(_scores(spark, sf_dir), 0.0, 0.000005, 100_001))
    return best.select(r("threshold").alias("threshold"), r("f1").alias("f1"))


@query(f"""WITH {PU_SQL} SELECT cluster, count(*) FILTER (label = 'Normal' AND predicted = 'Anomalous') AS fp,
  count(*) FILTER (label = 'Anomalous' AND predicted = 'Normal') AS fn FROM pc GROUP BY cluster""")
def errors_by_cluster(spark, sf_dir):
    return E.errors_by_cluster(pu(spark, sf_dir))


@query(f"""WITH {PU_SQL} SELECT rule, predicted, count(*) AS n FROM pc
WHERE rule <> 'labelled' GROUP BY 1, 2""")
def label_provenance(spark, sf_dir):
    return E.label_provenance(pu(spark, sf_dir))
