import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweir.operators import clusters as K
from logweir.operators import density as D
from logweir.operators import evaluate as E
from logweir.operators.next_event import NextEventModel
from tests.test_sessions import seq_of


def vec_frame(spark, x, **columns):
    rows = [(i, v.tolist()) for i, v in enumerate(np.asarray(x, float))]
    return spark.createDataFrame(rows, "session_idx bigint, vec array<double>").withColumn(
        "session_id", F.col("session_idx")
    )


def test_complete_linkage():
    angles = np.array([0, 0.05, 0.1, 1.0, 1.02, 2.5])
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    assert K.complete_linkage(x, 0.01).tolist() == [0, 0, 0, 1, 1, 2]
    # complete: the ends of a chain are too far apart for one cluster
    chain = np.stack([np.cos(np.arange(4) * 0.1), np.sin(np.arange(4) * 0.1)], axis=1)
    assert len(set(K.complete_linkage(chain, 0.006))) == 2


@pytest.mark.parametrize("block", [2, 4096])
def test_nearest_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_REPRESENTATIVES", block)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 5)), rng.normal(size=(7, 5))
    reps = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "cluster bigint, vec array<double>")
    d = K.cosine_matrix(x, y)
    for r in K.nearest(vec_frame(spark, x), reps).collect():
        i = r["session_idx"]
        assert r["cluster"] == d[i].argmin() and r["dist"] == pytest.approx(d[i].min())


def test_cluster_rounds_cover_everything(spark):
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(400, 4))) ** 3
    df = vec_frame(spark, np.vstack([x, x[:100]]))
    model = K.fit_log_clusters(df, max_dist=0.05, anomaly_threshold=0.05, bootstrap=40)
    assert model.representatives.agg(F.sum("size")).first()[0] == 500
    flagged = model.transform(df).filter("predicted = 'Anomalous'").count()
    assert flagged < 100
    empty = K.LogClusterModel(model.representatives.limit(0))
    assert empty.transform(df).filter("predicted = 'Normal'").count() == 0


def brute_density(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core_dist = np.sort(d, axis=1)[:, m - 1]
    core = core_dist <= eps
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = label.copy()
        for i in np.flatnonzero(core):
            new[i] = label[(d[i] <= eps) & core].min()
        if (new == label).all():
            return label, core_dist
        label = new


@pytest.mark.parametrize("tile", [15, 2000])
def test_density_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(D.tiles, "__defaults__", (tile,))
    rng = np.random.default_rng(3)
    blobs = [rng.normal(c, 0.3, size=(60, 3)) for c in (0, 4, 9)]
    x = np.vstack(blobs + [rng.uniform(-5, 15, size=(20, 3))]).round(2)
    x = np.vstack([x, x[:10]])
    label, core = brute_density(x, 0.6, 5)
    got = (
        D.DensityClusters(0.6, 10, 5).fit_predict(vec_frame(spark, x)).toPandas()
        .set_index("session_idx").sort_index()
    )
    sizes = pd.Series(label).value_counts()
    keep = np.array([l != -1 and sizes[l] >= 10 for l in label])
    assert ((got["cluster"] != -1).to_numpy() == keep).all()
    pairs = set(zip(got["cluster"][keep], label[keep]))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    low = pd.Series(core)[keep].groupby(label[keep]).transform("min")
    want = np.where(core[keep] == 0, 1.0, 1 - low / np.where(core[keep] == 0, 1, core[keep]))
    assert np.allclose(got["outlier"][keep], want)


def test_crowded_cells_are_not_copied_into_many_tiles(spark):
    points = spark.range(6000).select(F.col("id").alias("pid"), F.lit(1).cast("bigint").alias("w"), F.array(
        F.pmod(F.xxhash64("id"), F.lit(1000)) / 1e6, F.pmod(F.hash("id"), F.lit(1000)) / 1e6, F.lit(0.0)
    ).alias("vec"))
    assert D.tiles(points, 1.0).groupBy("pid").count().agg(F.max("count")).first()[0] <= 10


@pytest.mark.parametrize("shift, unit", [(0, 1.0), (1000, 1.0), (0, 1e18), (0, 1e-20)])
def test_pairs_of_a_tile(monkeypatch, shift, unit):
    monkeypatch.setattr(D, "CELLS", 500)
    rng = np.random.default_rng(8)
    x = (rng.integers(0, 4, size=(150, 6)) + shift) * unit
    y = np.vstack([x[:40], (rng.integers(0, 4, size=(90, 6)) + shift) * unit])
    x[100, 2], y[50] = np.nan, np.inf
    ids = [*range(150), *range(40), *range(500, 550), 100, *range(600, 639)]   # a vector that is no number is near itself
    frame = pd.DataFrame({
        "pid": ids, "w": 1, "vec": [*x, *y], "side": [0] * 150 + [1] * 130,
    })
    eps = 3 * unit   # many pairs lie exactly there
    tile = D._Tile(frame, 6, eps)
    found = {
        (row, c) for row, hit, _, _ in tile.candidates() for c, d in zip(hit, tile.distances(row, hit)) if d <= eps
    }
    with np.errstate(invalid="ignore"):
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    d[tile.px[:, None] == tile.py[None]] = 0
    assert found == set(zip(*np.nonzero(d <= eps)))


def test_labels_and_soft_targets(spark):
    rows = [
        (1, 0, [1.0], 0.3), (2, 0, [2.0], float("nan")), (3, 1, [3.0], 0.4),
        (4, -1, [5.0], None), (5, -1, [6.0], None), (6, -1, [5.0], None),
    ]
    df = spark.createDataFrame(rows, "session_id bigint, cluster int, vec array<double>, outlier double")
    labelled = spark.createDataFrame([(1,), (6,)], "session_id bigint")
    out = D.with_confidence(D.propagate_labels(df, labelled))
    got = {r["session_id"]: (r["predicted"], r["rule"], r["confidence"]) for r in out.collect()}
    assert got == {
        1: ("Normal", "labelled", 0.0), 2: ("Normal", "cluster", 1.0),
        3: ("Anomalous", "cluster", 0.4), 4: ("Normal", "distance", 0.0),
        5: ("Anomalous", "distance", 0.0), 6: ("Normal", "labelled", 0.0),
    }
    soft = D.soft_targets(out.withColumn("label", F.lit("Normal"))).filter("session_id = 3")
    assert {r["class"]: r["weight"] for r in soft.collect()} == {"Anomalous": 0.8, "Normal": 0.2}


def test_next_event(spark):
    train = seq_of(spark, {"a": [1, 2, 3, 1, 2, 3, 1, 2, 4]})
    model = NextEventModel.fit(train, h=2)
    test = seq_of(spark, {"ok": [1, 2, 3, 1], "rare": [1, 2, 4], "short": [1, 2], "new": [1, 2, 9]})
    flags = lambda g: {r[0] for r in model.flag_sessions(test, g).collect() if r[1] == "Anomalous"}
    assert flags(1) == {"rare", "short", "new"}
    assert flags(2) == {"short", "new"}
    # an unseen window falls back to its last event
    worst = {r[0]: r[1] for r in model.worst_ranks(seq_of(spark, {"x": [9, 1, 2]})).collect()}
    assert worst == {"x": 1}


def test_metrics_without_true_positive(spark):
    df = spark.createDataFrame([("Normal", "Anomalous")] * 3, "label string, predicted string")
    row = E.prf(E.confusion(df)).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0, 0, 0) and row["fp"] == 3


@pytest.mark.parametrize("strict", [True, False])
def test_sweep(spark, strict):
    rng = np.random.default_rng(4)
    score = rng.integers(0, 12, 300) * 0.1
    label = np.where(rng.random(300) < 0.3 + score / 3, "Anomalous", "Normal")
    df = spark.createDataFrame(list(zip(score.tolist(), label.tolist())), "score double, label string")
    best = (0.0, 0.0)
    for r in E.sweep(df, 0.0, 0.1, 11, strict).orderBy("i").collect():
        flag = score > r["i"] * 0.1 if strict else score >= r["i"] * 0.1
        tp = int((flag & (label == "Anomalous")).sum())
        fp = int((flag & (label == "Normal")).sum())
        assert (r["tp"], r["fp"]) == (tp, fp)
        best = max(best, (r["f1"], -r["threshold"]), key=lambda b: (b[0], b[1]))
    row = E.best_threshold(E.sweep(df, 0.0, 0.1, 11, strict)).first()
    assert (row["f1"], -row["threshold"]) == best


def test_tied_orders_keep_every_vector(spark):
    from logweir.operators.clusters import fit_log_clusters

    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [-1.0, 0.0]), (None, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "session_idx bigint, vec array<double>")
    model = fit_log_clusters(df, bootstrap=1)
    assert model.representatives.agg({"size": "sum"}).first()[0] == 4


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_next_event_tables_that_grow_are_not_broadcast(spark):
    """A stage of alike rows is a small file, so its size on disk must not send its rows through the driver."""
    from logweir.operators.next_event import sweep_candidates
    from logweir.plans.next_events import NextEventDetector, distinct_sessions
    from logweir.session import materialise

    rows = [(f"s{i}", p, "abcab"[p]) for i in range(40) for p in range(5)]
    seq = materialise(spark.createDataFrame(rows, "session_id string, pos bigint, event string"), "sequences")
    labels = materialise(spark.createDataFrame(
        [(f"s{i}", "Anomalous" if i % 5 == 0 else "Normal") for i in range(40)], "session_id string, label string"), "labels")
    for backoff in (True, False):
        fitted = NextEventDetector.fit(seq, labels, h=2, candidates=1, backoff=backoff)
        worst = fitted.model.worst_ranks(seq)
        assert "Broadcast" not in plan_of(worst)
        assert {r["worst"] for r in worst.collect()} == {1}
    distinct, kept = distinct_sessions(seq, labels)
    assert "Broadcast" not in plan_of(distinct) and kept.count() == 2
    swept = sweep_candidates(worst, labels, 1)
    assert "BroadcastExchange HashedRelationBroadcastMode(List(input[0, string" not in plan_of(swept)
    assert [(r["tp"], r["fp"], r["fn"]) for r in swept.collect()] == [(0, 0, 8)]
