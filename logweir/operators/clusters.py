"""Cosine clusters of session vectors (Lin et al., ICSE 2016).

The first vectors are clustered by complete linkage. All others join the nearest representative within reach, which moves to the
mean; where none is near, new representatives are opened in rounds: vectors that share a random-hyperplane bucket are
compared exactly, and those without a neighbour of smaller (seeded, random) priority become representatives, unless an exact
search finds one of them near another. Bucket collisions only propose; which vector joins what is always decided by
the exact nearest representative. Priorities make the rounds few whatever the order of the vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from logweir.functions.matrices import map_vectors
from logweir.functions.vectors import sum_vectors, vector_size
from logweir.operators.evaluate import verdict
from logweir.operators.nearest import cosine_matrix, nearest_in_lists
from logweir.operators.ranks import sorted_index
from logweir.session import materialise

BOOTSTRAP = 1000
BLOCK_REPRESENTATIVES = 4096
BANDS = 6            # buckets of a vector
BUCKET_ROWS = 512    # vectors of a bucket that are compared


def complete_linkage(x: np.ndarray, max_dist: float) -> np.ndarray:
    """Cluster number per row: complete linkage cut at ``max_dist``. Rows are bounded."""
    n = len(x)
    d = cosine_matrix(x, x)
    np.fill_diagonal(d, np.inf)
    owner = np.arange(n)
    while n > 1:
        i, j = divmod(int(np.argmin(d)), n)
        if not d[i, j] <= max_dist:
            break
        i, j = min(i, j), max(i, j)
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        owner[owner == j] = i
    return np.unique(owner, return_inverse=True)[1]


def nearest(df: DataFrame, representatives: DataFrame, vec: str = "vec") -> DataFrame:
    """Adds `dist` and `cluster` of the nearest representative (ties: lowest cluster).

    Up to ``BLOCK_REPRESENTATIVES`` representatives (cluster, vec) go to the tasks as one block, one narrow pass. More are
    found through inverted lists, or, on a stream, block by block in the same pass. Without representatives the distance is infinite.
    """
    some = representatives.orderBy("cluster").limit(BLOCK_REPRESENTATIVES + 1).collect()
    if not some:
        return df.withColumn("dist", F.lit(float("inf"))).withColumn("cluster", F.lit(-1).cast("bigint"))
    if len(some) <= BLOCK_REPRESENTATIVES:
        return _nearest_of_block(df, some, vec)
    if df.isStreaming:
        return _nearest_by_blocks(df, representatives, vec)
    found = materialise(nearest_in_lists(df, representatives, vec), "nearest").withColumnRenamed("vec", vec)
    return df.join(found, vec).select(*df.columns, "dist", "cluster")


def _nearest_of_block(df: DataFrame, rows: list, vec: str) -> DataFrame:
    y = np.array([r["vec"] for r in rows], dtype=float)
    names = np.array([r["cluster"] for r in rows], dtype=np.int64)

    def closest(x):
        d = cosine_matrix(x, y)
        best = np.argmin(d, axis=1)
        return [x, d[np.arange(len(x)), best], names[best]]

    held = map_vectors(df, vec, y.shape[1], closest, f"{vec} array<double>, dist double, cluster bigint")
    return held.select(*df.columns, "dist", "cluster")


def _nearest_by_blocks(df: DataFrame, representatives: DataFrame, vec: str) -> DataFrame:
    ids = representatives.agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).first()
    out = df.withColumn("dist", F.lit(float("inf"))).withColumn("cluster", F.lit(-1).cast("bigint"))
    for start in range(ids["lo"], ids["hi"] + 1, BLOCK_REPRESENTATIVES):
        block = F.col("cluster").between(start, start + BLOCK_REPRESENTATIVES - 1)
        rows = representatives.filter(block).orderBy("cluster").collect()
        if rows:
            held = out.withColumnRenamed("dist", "_d").withColumnRenamed("cluster", "_c")
            closer = F.col("dist") < F.col("_d")
            out = _nearest_of_block(held, rows, vec).select(
                *df.columns, F.when(closer, F.col("dist")).otherwise(F.col("_d")).alias("dist"),
                F.when(closer, F.col("cluster")).otherwise(F.col("_c")).alias("cluster"),
            )
    return out


@dataclass
class LogClusterModel:
    """`representatives` (cluster, vec, size) and the clusters known to be normal."""

    representatives: DataFrame
    anomaly_threshold: float = 0.3
    normal_clusters: DataFrame | None = None

    def transform(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        """Adds `dist`, `cluster`, `predicted`; threshold None or 0 means the fitted one.

        With known normal clusters, a vector nearest to any other cluster is flagged too.
        """
        limit = threshold if threshold else self.anomaly_threshold
        near = nearest(df, self.representatives)
        if self.normal_clusters is None:
            return near.withColumn("predicted", verdict(F.col("dist") > limit))
        known = self.normal_clusters.select("cluster", F.lit(True).alias("_known"))
        any_known = known.agg(F.count("*") > 0).scalar()
        return (
            near.join(known, "cluster", "left")
            .withColumn(
                "predicted",
                verdict((F.col("dist") > limit) | (any_known & F.col("_known").isNull())),
            )
            .drop("_known")
        )

    def with_known_normals(self, labelled: DataFrame) -> "LogClusterModel":
        """Clusters nearest to a labelled-normal vector are the known normal ones."""
        clusters = materialise(
            nearest(labelled, self.representatives).select("cluster").distinct(), "normal-clusters"
        )
        return LogClusterModel(self.representatives, self.anomaly_threshold, clusters)


def _bootstrap(points: DataFrame, max_dist: float, n: int) -> tuple[DataFrame, DataFrame]:
    """Representatives (cluster, vec, size) of the first ``n`` points (ties by vector), and the other points."""
    first = materialise(points.orderBy("ord", "vec").limit(n), "first")

    def link(frames):
        frame = pd.concat(frames).sort_values(["ord", "key"], na_position="first", kind="stable")
        x, w = np.stack(frame["vec"].to_numpy()).astype(float), frame["n"].to_numpy(float)
        owner = complete_linkage(x, max_dist)
        for c in range(owner.max() + 1):
            mine = owner == c
            center = (x[mine] * w[mine, None]).sum(axis=0) / w[mine].sum()
            yield pd.DataFrame({"cluster": [c], "vec": [center.tolist()], "size": [int(w[mine].sum())]})

    made = first.select("vec", "n", "ord", F.xxhash64("vec").alias("key")).repartition(1).mapInPandas(
        link, "cluster bigint, vec array<double>, size bigint"
    )
    return materialise(made, "representatives"), points.join(first.select("vec"), "vec", "left_anti")


def bucket_keys(x: np.ndarray, bits: int, bands: int = BANDS, seed: int = 7) -> np.ndarray:
    """One key per band: the sides of ``bits`` random hyperplanes a vector lies on."""
    planes = np.random.default_rng(seed).normal(size=(x.shape[1], bands * bits))
    side = (x @ planes > 0).reshape(len(x), bands, bits)
    return side @ (1 << np.arange(bits, dtype=np.int64))


def choose_leaders(rest: DataFrame, max_dist: float, bits: int) -> DataFrame:
    """(vec, n, ord) of points that open clusters: none is within ``max_dist`` of another one.

    A point is proposed if it is among the ``BUCKET_ROWS`` first of each of its buckets by priority and no earlier one there is near it.
    Of two proposed points that share no bucket the later one is dropped by exact search.
    """
    width = vector_size(rest)
    points = materialise(rest.select(
        F.xxhash64(F.lit("priority"), "vec").alias("prio"), "n", "ord", "vec"
    ), "points")
    keyed = map_vectors(
        points.select("prio", "vec"), "vec", width, lambda x: [list(bucket_keys(x, bits))], "keys array<bigint>"
    ).select("prio", F.posexplode("keys").alias("band", "key"))
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("prio"), F.lit(64)))
    place = ["band", "key"]
    some = salted.withColumn("_r", F.row_number().over(W.partitionBy(*place, "_salt").orderBy("prio"))).filter(
        F.col("_r") <= BUCKET_ROWS
    )
    first = some.withColumn("_r", F.row_number().over(W.partitionBy(*place).orderBy("prio"))).filter(
        F.col("_r") <= BUCKET_ROWS
    ).select("prio", *place)

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("prio")
        x = np.stack(frame["vec"].to_numpy()).astype(float)
        near = np.tril(cosine_matrix(x, x) <= max_dist, -1).any(axis=1)
        return pd.DataFrame({"prio": frame["prio"], "blocked": near})

    judged = first.join(points.select("prio", "vec"), "prio").groupBy(*place).applyInPandas(judge, "prio bigint, blocked boolean")
    free = judged.groupBy("prio").agg(F.max("blocked").alias("blocked"), F.count("*").alias("bands")).filter(
        ~F.col("blocked") & (F.col("bands") >= BANDS)
    )
    proposed = materialise(points.join(free.select("prio"), "prio").select(F.col("prio").alias("rank"), "n", "ord", "vec"), "proposed")
    known = nearest_in_lists(
        proposed, proposed.select(F.col("rank").alias("cluster"), "rank", "vec"), rank="rank"
    )
    alone = known.filter(F.col("dist") > max_dist).select("rank")
    return proposed.join(alone, "rank").select("vec", "n", "ord")


def fit_log_clusters(
    df: DataFrame,
    max_dist: float = 0.3,
    anomaly_threshold: float = 0.3,
    bootstrap: int = BOOTSTRAP,
    order: str = "session_idx",
    start: DataFrame | None = None,
) -> LogClusterModel:
    """Fit representatives on (session_idx, vec); ``start`` continues from earlier ones.

    Work is on distinct vectors with their multiplicity. Without representatives the first ``bootstrap`` vectors are linked. Every
    round moves the vectors within ``max_dist`` of a representative into it (weighted mean) and opens clusters among those left.
    """
    spark = df.sparkSession
    rest = materialise(
        df.groupBy("vec").agg(F.count("*").alias("n"), F.min(order).alias("ord")), "vectors"
    )
    reps = start if start is not None else spark.createDataFrame([], "cluster bigint, vec array<double>, size bigint")
    if reps.isEmpty() and not rest.isEmpty():
        reps, rest = _bootstrap(rest, max_dist, bootstrap)
    bits = max(2, min(24, math.ceil(math.log2(max(rest.count(), 2) / 64)) + 1))
    while not rest.isEmpty():
        near = materialise(nearest(rest, reps), "assigned")
        reps = materialise(_moved(reps, near.filter(F.col("dist") <= max_dist)), "representatives")
        rest = near.filter(F.col("dist") > max_dist).select("vec", "n", "ord")
        if rest.isEmpty():
            break
        last = reps.agg(F.max("cluster")).first()[0]
        leaders = materialise(choose_leaders(rest, max_dist, bits), "leaders")
        opened = sorted_index(leaders, "ord", "vec", out="_i").select(
            (F.col("_i") + last + 1).alias("cluster"), "vec", F.col("n").alias("size")
        )
        reps = materialise(reps.unionByName(opened), "representatives")
        rest = materialise(rest.join(leaders.select("vec"), "vec", "left_anti"), "rest")
        bits = min(bits + 4, 60)   # unlike vectors that share crowded buckets part in later rounds
    return LogClusterModel(materialise(reps, "representatives"), anomaly_threshold)


def _moved(reps: DataFrame, joined: DataFrame) -> DataFrame:
    """Representatives at the weighted mean with the vectors that joined them."""
    added = sum_vectors(joined, ["cluster"], "vec", F.col("n")).join(
        joined.groupBy("cluster").agg(F.sum("n").alias("m")), "cluster"
    )
    mean = F.zip_with("vec", "add", lambda v, a: (v * F.col("size") + a) / (F.col("size") + F.col("m")))
    return reps.join(added.withColumnRenamed("vec", "add"), "cluster", "left").select(
        "cluster", F.when(F.col("m").isNull(), F.col("vec")).otherwise(mean).alias("vec"),
        (F.col("size") + F.coalesce("m", F.lit(0))).alias("size"),
    )
