import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.functions.vectors import cosine_distance
from logweir.operators import features as X
from logweir.operators.ica import IcaModel
from logweir.operators.pca import PcaDetector, q_threshold
from logweir.plans.detectors import CountPca
from tests.test_sessions import seq_of


def test_idf_of_constant_event(spark):
    counts = X.event_counts(seq_of(spark, {"a": [1, 1], "b": [1, 2]}))
    idf = {r["event"]: r["idf"] for r in X.fit_idf(counts).collect()}
    assert idf[1] == pytest.approx(0, abs=1e-7) and idf[2] == pytest.approx(math.log(2))


def test_oov_counts_distinct(spark):
    model = X.CountModel.fit(seq_of(spark, {"a": [1, 2], "b": [1]}), oov=True)
    got = model.transform(seq_of(spark, {"t": [1, 9, 9, 8]})).collect()
    assert {r["event"]: r["x"] for r in got} == {"1": 1.0, "<oov>": 2.0}


def test_sessions_without_known_events_stay(spark):
    train = seq_of(spark, {"a": [1, 2], "b": [1], "c": [2, 2]})
    test = seq_of(spark, {"x": [9], "y": [1]})
    model = X.CountModel.fit(train, None, "zero-mean")
    got = {(r["session_id"], r["event"]): r["x"] for r in model.transform(test).collect()}
    assert got[("x", 1)] == pytest.approx(-2 / 3) and got[("x", 2)] == pytest.approx(-1.0)
    scored = CountPca.fit(train, n_components=1).transform(test).collect()
    assert {r["session_id"]: r["predicted"] for r in scored}["x"] == "Normal"


@pytest.mark.parametrize("weighting", [None, "tf-idf"])
@pytest.mark.parametrize("normalisation", [None, "zero-mean", "sigmoid"])
def test_count_model_against_numpy(spark, weighting, normalisation):
    sessions = {"a": [1, 1, 2], "b": [2, 3], "c": [3, 3, 3, 1], "d": [1]}
    seq = seq_of(spark, sessions)
    x = np.array([[e.count(k) for k in (1, 2, 3)] for e in sessions.values()], float)
    if weighting:
        x = x * np.log(4 / ((x > 0).sum(0) + 1e-8))
    if normalisation == "zero-mean":
        x = x - x.mean(0)
    elif normalisation == "sigmoid":
        x = np.where(x != 0, 1 / (1 + np.exp(-x)), x)
    model = X.CountModel.fit(seq, weighting, normalisation)
    got = np.zeros_like(x)
    for r in model.transform(seq).collect():
        got[list(sessions).index(r["session_id"]), r["event"] - 1] = r["x"]
    assert np.allclose(got, x)
    dense = {r[0]: r[1] for r in X.dense_vectors(model.transform(seq), [1, 2, 3]).collect()}
    assert np.allclose([dense[s] for s in sessions], x)


def test_template_vectors_repeated_token(spark):
    templates = spark.createDataFrame([(1, "a a b"), (2, "c"), (3, "-- __")], "template_id int, template string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vec array<double>")
    got = {r[0]: r[1] for r in X.template_vectors(templates, vectors).collect()}
    idf_a, idf_b = math.log(3 / 2), math.log(3)
    assert np.allclose(got[1], [2 * (2 / 3) * idf_a, (1 / 3) * idf_b])
    assert got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]
    rate = X.oov_rate(templates, vectors).first()
    assert (rate["missing"], rate["total"]) == (1, 4)


@pytest.mark.parametrize("frequent_bytes", [0, 16, 1 << 20])
def test_template_vectors_whatever_is_frequent(spark, frequent_bytes):
    """Tokens whose vectors go to every task and those that meet theirs by a join add up to the same."""
    templates = spark.createDataFrame(
        [(1, "a a b"), (1, "a b b"), (2, "c d"), (None, "a"), (4, "b c q")], "template_id int, template string"
    )
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, 1.0]), ("d", [0.5, 0.5])], "token string, vec array<double>"
    )
    rows = X.template_vectors(templates, vectors, frequent_bytes=frequent_bytes).collect()
    got = {r[0]: r[1] for r in rows}
    a, b, c, d = math.log(5 / 4), math.log(5 / 4), math.log(5 / 2), math.log(5)
    assert np.allclose(got[1], [9 / 3 * a, 9 / 3 * b])
    assert np.allclose(got[2], [c + d / 4, c / 2 + d / 4])
    assert np.allclose(got[4], [2 / 3 * c, b / 3 + c / 3])
    assert got[None] == [0.0, 0.0] and len(rows) == 5


def test_word_vector_keeps_missing_in_divisor(spark):
    tokens = spark.createDataFrame([("addStoredBlock",)], "token string")
    vectors = spark.createDataFrame([("add", [3.0]), ("block", [6.0])], "token string, vec array<double>")
    assert X.word_vectors_mean(tokens, vectors).first()["vec"] == [3.0]


def test_sequence_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [10.0, 0.0])], "event int, vec array<double>")
    got = X.sequence_vectors(seq_of(spark, {"a": [1, 1, 2, 7], "b": [7]}), vectors).collect()
    assert {r[0]: r[1] for r in got} == {"a": [12.0, 4.0], "b": [0.0, 0.0]}


def test_cosine(spark):
    rows = [([0.0, 0.0], [0.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine_distance("a", "b")).collect()] == [0.0, 1.0, 1.0, 0.0]


@pytest.mark.parametrize("n_components", [3, 0.9])
def test_pca_against_numpy(spark, n_components):
    x = np.random.default_rng(6).normal(size=(200, 8)) * np.arange(1, 9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    model = PcaDetector.fit(df.repartition(7), n_components)
    values, vectors = np.linalg.eigh(x.T @ x / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = n_components if n_components >= 1 else int(np.argmax(np.cumsum(values) / values.sum() >= n_components)) + 1
    p = vectors[:, :k]
    spe = ((x - x @ p @ p.T) ** 2).sum(1)
    got = {r["id"]: r for r in model.transform(df).collect()}
    assert np.allclose([got[i]["spe"] for i in range(200)], spe)
    assert model.threshold == pytest.approx(q_threshold(values, k))
    assert [got[i]["predicted"] == "Anomalous" for i in range(200)] == list(spe > model.threshold)
    assert model.transform(df, 0.5).filter("predicted = 'Anomalous'").count() == (spe > 0.5).sum()


def test_q_threshold_without_residual():
    assert q_threshold(np.array([3.0, 1.0]), 2) == 0.0


def test_ica_separates_sources(spark):
    rng = np.random.default_rng(0)
    sources = np.stack([np.sign(rng.normal(size=3000)), rng.uniform(-1, 1, 3000)], axis=1)
    x = sources @ np.array([[1.0, 0.5, 0.2], [0.3, 1.0, -0.4]])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>")
    model = IcaModel.fit(df, k=2)
    out = (x - model.mean) @ model.components.T
    corr = np.abs(np.corrcoef(out.T, sources.T)[:2, 2:])
    assert sorted(np.argmax(corr, axis=1)) == [0, 1] and corr.max(axis=1).min() > 0.98


def test_oov_entry_without_rare_train_events(spark):
    from math import log

    from logweir.operators.features import OOV, CountModel

    rows = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("b", 1, "y")]
    train = spark.createDataFrame(rows, "session_id string, pos bigint, event string")
    test = spark.createDataFrame([("c", 0, "x"), ("c", 1, "new"), ("c", 2, "newer")], train.schema)
    got = CountModel.fit(train, "tf-idf", oov=True).transform(test).collect()
    found = {r["event"]: r["x"] for r in got}
    assert abs(found[OOV] - 2 * log(2 / 1e-8)) < 1e-9
    centred = CountModel.fit(train, "tf-idf", "zero-mean", oov=True).transform(test).collect()
    assert abs({r["event"]: r["x"] for r in centred}[OOV] - 2 * log(2 / 1e-8)) < 1e-9
