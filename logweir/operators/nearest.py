"""Nearest representatives by cosine distance through inverted lists, exact at any number of representatives.

``CENTERS`` representatives, picked by a hash, are centres; every other one lies in the list of its nearest centre, and a list
keeps the largest angle to its centre. By the triangle inequality on angles no member of a list is nearer to a vector than the angle to
its centre less that radius, so after the own list of a vector only lists with a smaller bound than the best distance so far
are visited. Lists and visits are tables: a visit meets a part of a list in a task that holds at most ``LIST_ROWS``
representatives and about ``QUERY_ROWS`` vectors. Only the centres, radii and sizes of the lists are known to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logweir.functions.matrices import map_vectors
from logweir.functions.vectors import vector_size
from logweir.session import materialise

CENTERS = 512
LIST_ROWS = 4096
QUERY_ROWS = 1 << 15
SLACK = 1e-7


def cosine_matrix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine distances of all rows of x to all rows of y."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    d = 1.0 - (x @ y.T) / (np.outer(nx, ny) + 1e-8)
    d[d < 1e-8] = 0.0
    d[np.outer(nx < 1e-8, ny < 1e-8)] = 0.0
    return d


def _angles(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Angles of all rows; a right angle where a row is zero."""
    n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(centers, axis=1)[None]
    return np.arccos(np.clip((x @ centers.T) / np.where(n > 0, n, 1.0), -1.0, 1.0))


def lower_bounds(angles: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Least possible distances to the members of each list; the damping of short vectors only makes acute ones longer."""
    nearest = np.maximum(angles - radii[None], 0.0)
    return 1.0 - np.maximum(np.cos(nearest), 0.0)


class Lists:
    """Representatives (cluster, vec[, rank]) dealt to lists of their nearest centres."""

    def __init__(self, representatives: DataFrame, centers: int = CENTERS):
        self.width = vector_size(representatives)
        # Zero vectors have no angle: they go to the list of the first centre, whose radius is then a half turn.
        some = representatives.orderBy(F.xxhash64("cluster"), "cluster").limit(centers).select("vec").collect()
        self.centers = np.array([r["vec"] for r in some], float).reshape(-1, self.width)
        held = self.centers

        def deal(x):
            angle = _angles(x, held)
            own = np.argmin(angle, axis=1)
            far = angle[np.arange(len(x)), own]
            zero = np.linalg.norm(x, axis=1) < 1e-8
            own[zero], far[zero] = 0, np.pi
            return [x, own, far]

        rest = representatives.select(*(c for c in representatives.columns if c in ("cluster", "rank")), "vec")
        self.members = materialise(
            map_vectors(rest, "vec", self.width, deal, "vec array<double>, list bigint, far double"), "lists"
        )
        self.radii, self.sizes = np.zeros(len(held)), np.zeros(len(held), np.int64)
        self.radii -= np.inf
        for r in self.members.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
            self.radii[r["list"]], self.sizes[r["list"]] = r["far"] + 1e-6, r["n"]

    def probe(self, visits: DataFrame) -> DataFrame:
        """(k1, k2, dist, cluster) of the nearest member per visit (k1, k2, vec, list[, rank]) and part of a list."""
        counts = {r["list"]: r["n"] for r in visits.groupBy("list").agg(F.count("*").alias("n")).collect()}
        deal = [(k, int(-(-self.sizes[k] // LIST_ROWS)), -(-n // QUERY_ROWS)) for k, n in counts.items() if self.sizes[k]]
        table = F.broadcast(visits.sparkSession.createDataFrame(deal, "list bigint, parts bigint, chunks bigint"))  # one row per list
        ranked = "rank" in visits.columns and "rank" in self.members.columns
        rank = ["rank"] if ranked else []
        group = ["list", "part", "chunk"]
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        asked = visits.join(table, "list").select(
            "list", every("parts").alias("part"), F.pmod("k1", F.col("chunks")).alias("chunk"), "k1", "k2", "vec", *rank
        )
        held = self.members.join(table, "list").select(
            "list", F.pmod(F.xxhash64("cluster"), F.col("parts")).alias("part"), every("chunks").alias("chunk"), "cluster", "vec", *rank
        )

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame([], columns=["k1", "k2", "dist", "cluster"], dtype=object)
            right = right.sort_values("cluster")
            y, names = np.stack(right["vec"].to_numpy()).astype(float), right["cluster"].to_numpy()
            out = []
            for at in range(0, len(left), 1024):
                part = left.iloc[at : at + 1024]
                d = cosine_matrix(np.stack(part["vec"].to_numpy()).astype(float), y)
                if ranked:
                    d[right["rank"].to_numpy()[None] >= part["rank"].to_numpy()[:, None]] = np.inf
                best = np.argmin(d, axis=1)
                out.append(pd.DataFrame({
                    "k1": part["k1"], "k2": part["k2"], "dist": d[np.arange(len(part)), best], "cluster": names[best],
                }))
            return pd.concat(out)

        return asked.groupBy(*group).cogroup(held.groupBy(*group)).applyInPandas(
            meet, "k1 bigint, k2 bigint, dist double, cluster bigint"
        )


def nearest_in_lists(df: DataFrame, representatives: DataFrame, vec: str = "vec", rank: str | None = None) -> DataFrame:
    """(vec[, rank], dist, cluster) of every distinct vector; ties go to the lowest cluster.

    With ``rank`` (a column of both tables) only representatives of a smaller rank count; without any the distance is infinite.
    """
    lists = Lists(representatives)
    width = lists.width
    extra = [F.col(rank).alias("rank")] if rank else []
    names = ["rank"] if rank else []
    asked = materialise(df.select(F.col(vec).alias("vec"), *extra).distinct().select(
        F.xxhash64("vec", *names).alias("k1"), F.xxhash64(F.lit(1), "vec", *names).alias("k2"), *names, "vec"
    ), "asked")
    centers, radii = lists.centers, lists.radii

    def own(x):
        return [x, np.argmin(np.where(np.isinf(radii)[None], np.inf, _angles(x, centers)), axis=1)]

    first = map_vectors(asked, "vec", width, own, "vec array<double>, list bigint")
    first = materialise(first, "own-lists")
    best = materialise(
        lists.probe(first).groupBy("k1", "k2").agg(F.min(F.struct("dist", "cluster")).alias("best")), "best"
    )

    def others(x):
        """Lower bounds per list as bytes of float64; compared with the best distance below."""
        return [x, list(lower_bounds(_angles(x, centers), radii))]

    bounded = map_vectors(
        first.join(best, ["k1", "k2"]).select("k1", "k2", *names, "list", F.col("best.dist").alias("most"), "vec"),
        "vec", width, others, "vec array<double>, bounds array<double>",
    )
    more = bounded.select(
        "k1", "k2", *names, "vec", F.col("list").alias("_own"), "most", F.posexplode("bounds").alias("list", "bound")
    ).filter(
        (F.col("list") != F.col("_own")) & (F.col("bound") <= F.col("most") + SLACK) & F.col("bound").isNotNull()
    ).select("k1", "k2", *names, "vec", F.col("list").cast("bigint").alias("list"))
    more = materialise(more, "other-lists")
    found = best.select("k1", "k2", F.col("best.dist").alias("dist"), F.col("best.cluster").alias("cluster"))
    if not more.isEmpty():
        found = found.unionByName(lists.probe(more)).groupBy("k1", "k2").agg(
            F.min(F.struct("dist", "cluster")).alias("best")
        ).select("k1", "k2", "best.*")
    return asked.join(found, ["k1", "k2"]).select("vec", *names, "dist", "cluster")
