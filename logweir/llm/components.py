"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweir.session import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node of it) of all nodes that have an edge to another one.

    Rounds of contraction: every node points to its smallest neighbour and edges move to the nodes pointed at,
    until none is left; then the pointers are followed back. A node with many edges is summed in parts. Rounds grow with the logarithm
    of the longest path in practice; every round works on the remaining edges only.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    left = materialise(both.union(both.select("y", "x")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        least = materialise(
            left.groupBy("x").agg(F.min("y").alias("y")).select(
                F.col("x").alias("node"), F.least("x", "y").alias("to")
            ), "least",
        )
        # A node's neighbours also see the smallest node around it, which halves the paths.
        wider = left.join(least, left.y == least.node).groupBy("x").agg(F.min("to").alias("to"))
        pointer = materialise(
            wider.select(F.col("x").alias("node"), F.least("x", "to").alias("to")), "pointer"
        )
        rounds.append(pointer)
        moved = left.join(pointer.select(F.col("node").alias("x"), F.col("to").alias("p")), "x").join(
            pointer.select(F.col("node").alias("y"), F.col("to").alias("q")), "y"
        ).select(F.col("p").alias("x"), F.col("q").alias("y")).filter("x <> y")
        left = materialise(moved.union(moved.select("y", "x")).distinct(), "edges")
    if not rounds:
        kind = left.schema["x"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    # Nodes that a later round moves on; all others are where they end.
    result = rounds[-1].select("node", F.col("to").alias("component"))
    for pointer in reversed(rounds[:-1]):
        later = result.select(F.col("node").alias("to"), "component")
        result = pointer.join(later, "to", "left").select(
            "node", F.coalesce("component", "to").alias("component")
        )
    return materialise(result, "components")
