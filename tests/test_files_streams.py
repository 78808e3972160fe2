import time

import pytest
from pyspark.sql import functions as F

from logweir.session import scratch_path
from logweir.sources import tables as A
from logweir.streaming import streams as X
from tests.test_sessions import seq_of


def test_long_sequences_continue_on_further_lines(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(A, "PART", 7)
    sessions = {"a": list(range(20)), "b": [3], "d": [1] * 7, "job#3": list(range(9)), "job": [5, 6], "#1": [2]}
    seq = seq_of(spark, sessions)
    path = str(tmp_path / "seq")
    A.write_sequences(seq, path, "event")
    got = A.read_sequences(spark, path, "event", "int")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, seq.collect()))


def test_templates_with_commas(spark, tmp_path):
    path = tmp_path / "t"
    path.write_text("0,a, b,c\n1,d\n")
    assert [tuple(r) for r in A.read_templates(spark, str(path)).orderBy("template_id").collect()] == [
        (0, "a, b,c"), (1, "d"),
    ]


def test_label_names(spark, tmp_path):
    path = tmp_path / "l"
    path.write_text("blk_1,Anomaly\nblk_-2,Normal\n")
    assert {tuple(r) for r in A.read_labels(spark, str(path)).collect()} == {
        ("blk_1", "Anomalous"), ("blk_-2", "Normal"),
    }


def test_instance_lines(spark, tmp_path):
    sessions = spark.createDataFrame([("a", "Normal", "Anomalous", 0.5)],
                                     "session_id string, label string, predicted string, confidence double")
    A.write_instances(seq_of(spark, {"a": [4, 2]}), sessions, str(tmp_path / "i"))
    text = "".join(p.read_text() for p in (tmp_path / "i").glob("part-*"))
    assert text == "4 2\na,Normal,Anomalous,0.5\n\n"


def test_long_instances_have_one_id_line(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(A, "PART", 2)
    sessions = spark.createDataFrame([("a#1", "Normal"), ("b", "Anomalous")], "session_id string, label string")
    A.write_instances(seq_of(spark, {"a#1": [4, 2, 7], "b": [1]}), sessions, str(tmp_path / "i"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "i").glob("part-*")))
    assert text == "4 2\n7\na#1,Normal\n\n1\nb,Anomalous\n\n"


def test_malformed_lines_are_reported_not_read(spark, tmp_path):
    path = tmp_path / "t"
    path.write_text("0,a b\nno separator\nx,c\n\n")
    assert {tuple(r) for r in A.read_templates(spark, str(path)).collect()} == {(0, "a b"), (None, "c")}
    assert [r.value for r in A.unmatched_lines(spark, str(path), A.TEMPLATE_LINE).collect()] == ["no separator"]


def test_late_lines_are_dropped_after_the_watermark(spark):
    path = scratch_path(spark, "late")
    day = "2024-01-01 "
    batches = [
        [(day + "00:10:00", False), (day + "00:50:00", True)],
        [(day + "03:00:00", False)],
        [(day + "04:00:00", False)],
        [(day + "00:20:00", True), (day + "04:10:00", False)],
        [(day + "09:00:00", False)],
    ]
    for rows in batches:
        df = spark.createDataFrame(rows, "t string, is_alert boolean").select(
            F.col("t").cast("timestamp").alias("ts"), "is_alert"
        )
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = spark.readStream.schema("ts timestamp, is_alert boolean").option(
        "maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(spark, "late-out")
    (X.stream_sessions(stream).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch_path(spark, "late-state"))
     .trigger(availableNow=True).start().awaitTermination())
    got = {r["window_start"].hour: (r["n"], r["label"]) for r in spark.read.parquet(out).collect()}
    assert got == {0: (2, "Anomalous"), 3: (1, "Normal"), 4: (2, "Normal")}


def test_updaters_continue_after_a_restart(spark, tmp_path):
    from logweir.operators.clusters import fit_log_clusters
    from logweir.operators.mining import mine_templates

    lines = spark.createDataFrame(
        [(0, "open file now"), (1, "close socket 7 again"), (2, "open file now"), (3, "send all data out soon")],
        "log_id bigint, message string",
    )
    batch = lambda *ids: lines.filter(F.col("log_id").isin(*ids))
    start = mine_templates(batch(0)).templates
    first = X.TemplateUpdater(start, path=str(tmp_path / "t"))
    first(batch(1), 0)
    second = X.TemplateUpdater(start, path=str(tmp_path / "t"))
    second(batch(1), 0)  # replayed
    second(batch(2, 3), 1)
    found = {r["template"]: r["n"] for r in second.templates.collect()}
    assert found == {"open file now": 2, "close socket 7 again": 1, "send all data out soon": 1}

    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01])]
    vectors = spark.createDataFrame(rows, "session_idx bigint, vec array<double>")
    model = fit_log_clusters(vectors.filter("session_idx = 0"))
    X.ClusterUpdater(model, path=str(tmp_path / "c"))(vectors.filter("session_idx = 1"), 0)
    again = X.ClusterUpdater(model, path=str(tmp_path / "c"))
    again(vectors.filter("session_idx = 1"), 0)
    again(vectors.filter("session_idx = 2"), 1)
    assert sorted(r["size"] for r in again.model.representatives.collect()) == [1, 2]


def test_saved_models_score_alike(spark, tmp_path):
    from logweir import models
    from logweir.plans.detectors import ClusterDetector, CountPca
    from logweir.plans.next_events import NextEventDetector, QuantityDetector, SupervisedDetector

    sessions = {f"s{k}": [k % 3, 1, 2, k % 2, 1, 0, 2, 1] for k in range(12)}
    seq = seq_of(spark, sessions)
    labels = spark.createDataFrame(
        [(s, k, "Anomalous" if k % 4 == 3 else "Normal") for k, s in enumerate(sessions)],
        "session_id string, session_idx bigint, label string",
    )
    vectors = spark.createDataFrame([(k, [float(k == 0), float(k), 1.0]) for k in range(3)], "event int, vec array<double>")
    fitted = [
        CountPca.fit(seq), ClusterDetector.fit(seq, labels), NextEventDetector.fit(seq, labels, h=2, candidates=1),
        QuantityDetector.fit(seq, labels, h=2, candidates=1, hidden=4, max_iter=5),
        SupervisedDetector.fit(seq, labels, vectors),
    ]
    rows = lambda m: sorted(map(str, m.transform(seq).collect()))
    for k, model in enumerate(fitted):
        models.save(spark, model, str(tmp_path / str(k)))
        assert rows(models.load(spark, str(tmp_path / str(k)))) == rows(model)
    whole = fitted[2].transform(seq).join(labels, "session_id")
    from logweir.operators.evaluate import confusion, prf

    assert fitted[2].evaluate(seq, labels).collect() == prf(confusion(whole)).collect()
    assert fitted[4].evaluate(seq, labels).count() == fitted[3].evaluate(seq, labels).count() == 1
