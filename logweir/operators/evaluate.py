"""Confusion counts, precision / recall / F1 and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logweir.operators.sessions import ANOMALOUS, NORMAL


def confusion(
    df: DataFrame,
    label: str = "label",
    predicted: str = "predicted",
    weight: str | None = None,
    exclude: DataFrame | None = None,
    keys: tuple = (),
) -> DataFrame:
    """(tp, tn, fp, fn), weighted by multiplicity and without excluded sessions on demand."""
    if exclude is not None:
        df = df.join(exclude.select("session_id"), "session_id", "left_anti")
    w = F.lit(1) if weight is None else F.col(weight)
    truth, flag = F.col(label) == ANOMALOUS, F.col(predicted) == ANOMALOUS
    count = lambda cond, name: F.coalesce(
        F.sum(F.when(cond, w)), F.lit(0)
    ).cast("bigint").alias(name)
    return df.groupBy(*keys).agg(
        count(truth & flag, "tp"),
        count(~truth & ~flag, "tn"),
        count(~truth & flag, "fp"),
        count(truth & ~flag, "fn"),
    )


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 by counts: 2tp / (2tp + fp + fn), 0 without a true positive."""
    return F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def prf(counts: DataFrame, scale: float = 1.0) -> DataFrame:
    """Adds precision, recall and f1; all 0 when nothing was found."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda den: F.when(tp > 0, tp / den).otherwise(F.lit(0.0)) * scale
    return counts.select(
        *counts.columns,
        ratio(tp + fp).alias("precision"),
        ratio(tp + fn).alias("recall"),
        (f1_of(tp, fp, fn) * scale).alias("f1"),
    )


def sweep(
    scores: DataFrame, start: float, step: float, n: int, strict: bool = True, score: str = "score"
) -> DataFrame:
    """(i, threshold, tp, fp, fn, f1) for the thresholds start + i * step, i < n.

    Strict flags score > threshold, otherwise score >= threshold. One pass counts the
    scores per grid slot; the cumulative sums run over the grid, whose size is fixed.
    """
    thr = lambda i: F.lit(start) + i * F.lit(step)
    guess = F.ceil((F.col(score) - start) / step)
    over = (lambda i: thr(i) < F.col(score)) if strict else (lambda i: thr(i) <= F.col(score))
    slot = F.when(over(guess), guess + 1).when(over(guess - 1), guess).otherwise(guess - 1)
    slot = F.least(F.greatest(slot, F.lit(0)), F.lit(n))
    truth = F.col("label") == ANOMALOUS
    binned = scores.groupBy(slot.cast("bigint").alias("slot")).agg(
        F.count_if(truth).alias("p"), F.count_if(~truth).alias("q")
    )
    grid = scores.sparkSession.range(n + 1).withColumnRenamed("id", "slot")
    w = W.orderBy(F.col("slot").desc()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.col("slot").desc()).rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing
    )
    p, q = F.coalesce("p", F.lit(0)), F.coalesce("q", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    swept = grid.join(binned, "slot", "left").select(
        "slot",
        zero(F.sum(p).over(w)).alias("tp"),
        zero(F.sum(q).over(w)).alias("fp"),
        F.sum(p).over(everything).alias("_p"),
    )
    return (
        swept.filter(F.col("slot") < n)
        .withColumn("fn", F.col("_p") - F.col("tp"))
        .select(
            F.col("slot").alias("i"),
            thr(F.col("slot")).alias("threshold"),
            "tp",
            "fp",
            "fn",
            f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"),
        )
    )


def best_threshold(swept: DataFrame) -> DataFrame:
    """(threshold, f1) of the lowest threshold with the best F1."""
    best = F.max(F.struct("f1", (-F.col("i")).alias("_i"), "threshold"))
    return swept.agg(best.alias("b")).select(
        F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(F.lit(0.0)).alias("threshold"),
        F.col("b.f1").alias("f1"),
    )


def errors_by_cluster(df: DataFrame) -> DataFrame:
    """(cluster, fp, fn)."""
    truth, flag = F.col("label") == ANOMALOUS, F.col("predicted") == ANOMALOUS
    return df.groupBy("cluster").agg(
        F.count_if(~truth & flag).alias("fp"), F.count_if(truth & ~flag).alias("fn")
    )


def label_provenance(df: DataFrame) -> DataFrame:
    """(rule, predicted, n): decisions by cluster rule and by distance rule."""
    return df.filter(F.col("rule") != "labelled").groupBy("rule", "predicted").agg(
        F.count("*").alias("n")
    )


def verdict(flag: Column) -> Column:
    return F.when(flag, F.lit(ANOMALOUS)).otherwise(F.lit(NORMAL))
