"""Contiguous numbering without a single-task sort.

``row_number()`` over an unpartitioned order runs in one task. Here the order is cut
into slices, rows are numbered inside their slice, and the number of rows in the
earlier slices is added. The cuts are quantiles from a mergeable sketch, so slices are of about one size whatever the
distribution; a value that fills more than its slice is cut again by the quantiles of the first tie column. The slice table
is bounded by the number of slices, so it is the only thing that is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from logweir.session import scratch_path

SLICES = 4096
SLICE_ROWS = 4_000_000


def _earlier(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in the earlier slices, per key."""
    w = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")
    )


def _number_slices(
    cut: DataFrame, keys: Sequence[str], order: Sequence[Column], offsets: DataFrame, out: str
) -> DataFrame:
    w = W.partitionBy(*keys, "_slice").orderBy(*order)
    on = [*keys, "_slice"]
    return (
        cut.withColumn("_local", F.row_number().over(w) - 1)
        .join(F.broadcast(offsets), on, "left")
        .withColumn(out, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint"))
        .drop("_local", "_before", "_slice")
    )


def _quantiles(column: str, slices: int) -> Column:
    """Cuts of a numeric column into ``slices`` parts of about one size."""
    shares = ", ".join(f"{k / slices}D" for k in range(1, slices)) or "1D"
    return F.expr(f"percentile_approx(cast(`{column}` as double), array({shares}), {8 * max(slices, 100)})")


def _slice_of(df: DataFrame, column: str, cuts: Sequence[float], out: str) -> DataFrame:
    """Adds the number of cuts that are not above the value; -1 for a null, which sorts first."""
    from pyspark.ml.feature import Bucketizer

    counts = Counter(cuts)
    # A cut that repeats is a value of several shares: it gets a slice of its own.
    alone = [math.nextafter(c, math.inf) for c, n in counts.items() if n > 1]
    edges = [-math.inf, *sorted({*counts, *alone}), math.inf]
    if len(edges) < 3:
        return df.withColumn(out, F.when(F.col(column).isNull(), F.lit(-1)).otherwise(F.lit(0)))
    held = df.withColumn("_x", F.col(column).cast("double"))
    # A binary search per row; Bucketizer keeps the columns' order and types.
    found = Bucketizer(splits=edges, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(held)
    return found.withColumn(out, F.when(F.col(column).isNull(), F.lit(-1)).otherwise(F.col("_b").cast("int"))).drop("_x", "_b")


def cut_slices(df: DataFrame, order: str, ties: Sequence[str] = (), slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """(rows with `_slice`, rows per slice); slices follow the order and hold about one share of the rows each."""
    cuts = df.select(_quantiles(order, slices).alias("cuts")).first()["cuts"] or []
    cut = _slice_of(df, order, cuts, "_slice")
    sizes = cut.groupBy("_slice").agg(F.count("*").alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    rows = sizes.collect()   # one row per slice
    most = 2 * max(1, -(-sum(r["_n"] for r in rows) // slices))
    numeric = ties and isinstance(df.schema[ties[0]].dataType, T.NumericType)
    crowded = [r["_slice"] for r in rows if r["_n"] > most and r["_lo"] == r["_hi"]] if numeric else []
    spark = df.sparkSession
    if not crowded:
        table = spark.createDataFrame([(r["_slice"], r["_n"]) for r in rows], "_slice int, _n bigint")
        return cut, table
    # At most half of all slices can hold more than two shares, so the second cuts are bounded, too.
    share = {r["_slice"]: -(-2 * r["_n"] // most) for r in rows}
    inner = cut.filter(F.col("_slice").isin(crowded)).groupBy("_slice").agg(
        _quantiles(ties[0], max(share[k] for k in crowded)).alias("cuts")
    ).collect()
    place = F.lit(0)
    for r in inner:
        edges = F.expr("array(" + ", ".join(f"{float(c)!r}D" for c in sorted(set(r["cuts"] or []))) + ")")
        at = F.size(F.filter(edges, lambda c: c <= F.col(ties[0]).cast("double")))
        place = F.when(F.col("_slice") == r["_slice"], F.coalesce(at, F.lit(-1))).otherwise(place)
    parted = cut.withColumn("_slice", F.col("_slice").cast("bigint") * (4 * slices) + place)
    return parted, parted.groupBy("_slice").agg(F.count("*").alias("_n"))


def global_index(
    df: DataFrame, order: str, ties: Sequence[str] = (), out: str = "idx", slices: int = SLICES
) -> DataFrame:
    """0-based rank of every row by a numeric column (ties broken by ``ties``); nulls come first."""
    cut, counts = cut_slices(df, order, ties, slices)
    return _number_slices(
        cut, [], [F.col(order), *map(F.col, ties)], _earlier(counts, []), out
    )


def sorted_index(df: DataFrame, *order: str, out: str = "idx") -> DataFrame:
    """0-based rank of every row in the sort order of any columns.

    The rows are written once, sorted by ranges; a row's number is its place in its file plus
    the rows of the earlier files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "sorted")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    # A task writes several files where the session limits the rows of a file.
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, r"part-(\d+)", 1).cast("bigint") * 1_000_000 + F.coalesce(
        F.regexp_extract(name, r"-c(\d+)\.", 1).try_cast("bigint"), F.lit(0)
    )
    rows = spark.read.schema(df.schema).parquet(path).select(
        *df.columns, part.alias("_slice"), F.col("_metadata.row_index").alias("_local")
    )
    offsets = _earlier(rows.groupBy("_slice").agg(F.count("*").alias("_n")), [])
    return rows.join(F.broadcast(offsets), "_slice").select(
        *df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(out)
    )


def hash_order(key: str | Column, seed: int) -> Column:
    """Seeded uniform order: the hexadecimal md5 of ``seed:key``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_index(df: DataFrame, key: str, seed: int, out: str = "idx") -> DataFrame:
    """0-based rank of every row in the seeded order of ``key``.

    The first three hexadecimal digits of a hash are uniform, so they are the slices.
    """
    cut = df.withColumn("_hash", hash_order(key, seed)).withColumn(
        "_slice", F.substring("_hash", 1, 3)
    )
    counts = cut.groupBy("_slice").agg(F.count("*").alias("_n"))
    ranked = _number_slices(cut, [], [F.col("_hash"), F.col(key)], _earlier(counts, []), out)
    return ranked.drop("_hash")


def key_index(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    out: str = "pos",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """0-based rank of every row inside its key by an integral column.

    Keys with at most ``slice_rows`` rows are numbered by one window. Larger keys are
    cut into slices of their own order range, so a key that holds a third of all rows is
    spread over many tasks. There are at most ``rows / slice_rows`` large keys and
    ``2 * rows / slice_rows`` slices, which bounds both broadcast tables.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    large = (
        df.groupBy(*keys)
        .agg(
            F.count("*").alias("_rows"),
            F.min(order).cast("bigint").alias("_lo"),
            F.max(order).cast("bigint").alias("_hi"),
        )
        .filter(F.col("_rows") > slice_rows)
        .select(
            *keys,
            F.col("_lo"),
            F.ceil(
                (F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_rows") / slice_rows)
            ).alias("_width"),
        )
    )
    cut = df.join(F.broadcast(large), keys, "left").withColumn(
        "_slice",
        F.coalesce(F.floor((F.col(order) - F.col("_lo")) / F.col("_width")), F.lit(0)).cast("int"),
    )
    counts = (
        cut.filter(F.col("_width").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_n"))
    )
    ranked = _number_slices(
        cut.drop("_lo", "_width"),
        keys,
        [F.col(order), *map(F.col, ties)],
        _earlier(counts, keys),
        out,
    )
    return ranked
