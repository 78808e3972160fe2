"""Inverted lists, leaders and the rounds of online clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.operators import clusters as K
from logweir.operators import nearest as N


def frame(spark, x, name="session_idx"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.asarray(x, float))], f"{name} bigint, vec array<double>")


def clustered(seed, n, width):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, width))
    x = centers[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * 0.2
    x[: n // 20] = -x[: n // 20]
    x[0] = 0
    x[1] *= 1e-5   # the damping of short vectors
    return x


@pytest.mark.parametrize("rows", [4, 4096])
def test_lists_equal_the_full_comparison(spark, monkeypatch, rows):
    monkeypatch.setattr(N, "LIST_ROWS", rows)
    monkeypatch.setattr(N, "QUERY_ROWS", 50)
    monkeypatch.setattr(N, "CENTERS", 9)
    monkeypatch.setattr(N.Lists.__init__, "__defaults__", (9,))
    x, y = clustered(1, 150, 6), clustered(2, 90, 6)
    d = N.cosine_matrix(x, y)
    found = N.nearest_in_lists(frame(spark, x), frame(spark, y, "cluster")).collect()
    assert len(found) == len(x)
    at = {tuple(v.tolist()): i for i, v in enumerate(x)}
    for r in found:
        i = at[tuple(r["vec"])]
        assert r["dist"] == pytest.approx(d[i].min(), abs=1e-12) and d[i, r["cluster"]] == pytest.approx(d[i].min(), abs=1e-12)


def test_bounds_leave_out_lists(spark, monkeypatch):
    """Vectors visit few of the lists when the representatives lie in narrow cones."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16))
    y = np.repeat(centers, 20, 0) + rng.normal(size=(800, 16)) * 0.02
    x = centers[rng.integers(0, 40, 300)] + rng.normal(size=(300, 16)) * 0.02
    visits = []
    probe = N.Lists.probe
    monkeypatch.setattr(N.Lists, "probe", lambda self, v: visits.append(v.count()) or probe(self, v))
    monkeypatch.setattr(N.Lists.__init__, "__defaults__", (120,))
    found = N.nearest_in_lists(frame(spark, x), frame(spark, y, "cluster"))
    assert found.count() == 300
    assert sum(visits) < 300 * 120 / 6


def test_rank_only_looks_at_earlier_ones(spark):
    x = clustered(3, 60, 5)[2:]
    ranked = frame(spark, x, "rank")
    got = {r["rank"]: r["dist"] for r in N.nearest_in_lists(ranked, ranked.withColumn("cluster", F.col("rank")), rank="rank").collect()}
    d = N.cosine_matrix(x, x)
    for i in range(len(x)):
        assert got[i] == pytest.approx(d[i, :i].min() if i else float("inf"))


def test_leaders_are_apart_and_buckets_find_neighbours(spark):
    x = clustered(5, 400, 8)[2:]
    rest = frame(spark, x).select("vec", F.lit(1).alias("n"), F.col("session_idx").alias("ord"))
    chosen = np.array([r["vec"] for r in K.choose_leaders(rest, 0.1, 6).collect()])
    d = N.cosine_matrix(chosen, chosen)
    np.fill_diagonal(d, 9)
    assert len(chosen) > 5 and d.min() > 0.1
    keys = K.bucket_keys(x, 6)
    near = np.argwhere(np.triu(N.cosine_matrix(x, x) <= 0.02, 1))
    assert (keys[near[:, 0]] == keys[near[:, 1]]).any(axis=1).mean() >= 0.9


def test_unlike_vectors_need_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_REPRESENTATIVES", 200)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24))
    calls = []
    choose = K.choose_leaders
    monkeypatch.setattr(K, "choose_leaders", lambda *a: calls.append(1) or choose(*a))
    model = K.fit_log_clusters(frame(spark, x), max_dist=0.05, bootstrap=100)
    assert model.representatives.count() == 3000 and len(calls) <= 3
    assert model.representatives.select("cluster").distinct().count() == 3000


def test_all_vectors_near_a_representative_join(spark):
    x = np.abs(clustered(7, 500, 6)) + 0.01
    model = K.fit_log_clusters(frame(spark, x), max_dist=0.1, bootstrap=50)
    rows = model.representatives.collect()
    assert sum(r["size"] for r in rows) == 500
    d = N.cosine_matrix(x, np.array([r["vec"] for r in rows]))
    assert (d.min(axis=1) <= 0.2).all()
    again = K.fit_log_clusters(frame(spark, x).repartition(7), max_dist=0.1, bootstrap=50).representatives.collect()
    assert sorted((r["cluster"], r["size"]) for r in rows) == sorted((r["cluster"], r["size"]) for r in again)
