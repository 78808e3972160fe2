"""Dense vector columns (ARRAY<DOUBLE>)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - x.y / (|x||y| + 1e-8); tiny distances and two zero vectors give 0."""
    d = 1 - dot(a, b) / (norm(a) * norm(b) + 1e-8)
    both_zero = (norm(a) < 1e-8) & (norm(b) < 1e-8)
    return F.when(both_zero | (d < 1e-8), F.lit(0.0)).otherwise(d)


def vector_size(df: DataFrame, vec: str = "vec") -> int:
    """Length of the vectors of a table."""
    row = df.select(F.size(vec).alias("d")).first()
    return row["d"] if row else 0


def sum_vectors(
    df: DataFrame,
    keys: Sequence[str],
    vec: str = "vec",
    weight: Column | None = None,
    mean: bool = False,
) -> DataFrame:
    """Element-wise (weighted) sum or mean per key of the vectors that are not null.

    One aggregate of whole vectors, combined before the shuffle: nothing is exploded or collected, and the plan does not grow
    with the width. Weights may be negative.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    value = F.col(vec) if weight is None else F.transform(vec, lambda x: x * F.col("_weight"))
    rows = df.filter(F.col(vec).isNotNull())
    if weight is not None:
        rows = rows.withColumn("_weight", weight.cast("double"))
    added = rows.select(*keys, array_to_vector(value).alias("_v")).groupBy(*keys).agg(
        (Summarizer.mean if mean else Summarizer.sum)(F.col("_v")).alias("_v")
    )
    return added.select(*keys, vector_to_array("_v").alias(vec))
