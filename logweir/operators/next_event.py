"""Next-event models over windows: counts with back-off, or a perceptron."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from logweir.operators.evaluate import f1_of, verdict
from logweir.operators.windows import short_sessions, sliding_windows
from logweir.session import growing, materialise


def ranked_next(windows: DataFrame, context: str = "window") -> DataFrame:
    """(window, next_event, cnt, rank): most frequent next events first, then by event."""
    counts = windows.groupBy(context, "next_event").agg(F.count("*").alias("cnt"))
    order = W.partitionBy(context).orderBy(F.col("cnt").desc(), "next_event")
    return counts.withColumn("rank", F.row_number().over(order))


def _suffixes(windows: DataFrame, h: int) -> DataFrame:
    """One row per suffix length 0..h of the window, as `context`."""
    lengths = F.sequence(F.lit(0), F.lit(h))
    return windows.withColumn("level", F.explode(lengths)).withColumn(
        "context", F.slice("window", h + 1 - F.col("level"), F.col("level"))
    )


@dataclass
class NextEventModel:
    """`table` (level, context, next_event, cnt, rank) for window size ``h``."""

    table: DataFrame
    h: int
    backoff: bool

    @staticmethod
    def fit(seq: DataFrame, h: int = 10, backoff: bool = True) -> "NextEventModel":
        """Fit on normal sessions (session_id, pos, event)."""
        windows = (
            sliding_windows(seq, h).groupBy("window", "next_event").agg(F.count("*").alias("n"))
        )
        if backoff:
            contexts = _suffixes(windows, h)
        else:
            contexts = windows.withColumn("level", F.lit(h)).withColumn("context", F.col("window"))
        counts = contexts.groupBy("level", "context", "next_event").agg(F.sum("n").alias("cnt"))
        order = W.partitionBy("level", "context").orderBy(F.col("cnt").desc(), "next_event")
        table = counts.withColumn("rank", F.row_number().over(order))
        return NextEventModel(materialise(table, "next-events"), h, backoff)

    def candidates(self, g: int) -> DataFrame:
        """(level, context, next_event, cnt, rank) with rank <= g."""
        return self.table.filter(F.col("rank") <= g)

    def rank_windows(self, windows: DataFrame) -> DataFrame:
        """(window, next_event, rank): rank of the true next event in the longest known
        context; NULL when it never followed there. Distinct windows only."""
        pairs = windows.select("window", "next_event").distinct()
        if not self.backoff:
            known = self.table.select(F.col("context").alias("window"), "next_event", "rank")
            return pairs.join(growing(known), ["window", "next_event"], "left")
        contexts = self.table.select("level", "context").distinct()
        seen = (
            _suffixes(pairs.select("window").distinct(), self.h)
            .join(growing(contexts), ["level", "context"], "left_semi")
            .groupBy("window")
            .agg(F.max(F.struct("level", "context")).alias("_best"))
            .select("window", "_best.level", "_best.context")
        )
        known = self.table.select("level", "context", "next_event", "rank")
        return (
            pairs.join(growing(seen), "window", "left")
            .join(growing(known), ["level", "context", "next_event"], "left")
            .select("window", "next_event", "rank")
        )

    def worst_ranks(self, seq: DataFrame) -> DataFrame:
        """(session_id, worst): largest rank over the windows of a session; NULL ranks and
        short sessions count as never predicted (the largest integer)."""
        never = F.lit(2**31 - 1)
        windows = sliding_windows(seq, self.h)
        ranked = growing(windows).join(self.rank_windows(windows), ["window", "next_event"])
        scored = ranked.groupBy("session_id").agg(
            F.max(F.coalesce("rank", never)).alias("worst")
        )
        short = short_sessions(seq, self.h).select("session_id", never.alias("worst"))
        return scored.unionByName(short)

    def flag_sessions(self, seq: DataFrame, g: int) -> DataFrame:
        """(session_id, predicted): Anomalous on any miss within the top g, or when short."""
        return self.worst_ranks(seq).select(
            "session_id", verdict(F.col("worst") > g).alias("predicted")
        )


def sweep_candidates(worst: DataFrame, labels: DataFrame, max_g: int) -> DataFrame:
    """(g, tp, fp, fn, f1) for g = 1..max_g from one histogram of worst ranks."""
    truth = F.col("label") == "Anomalous"
    binned = (
        worst.join(growing(labels.select("session_id", "label")), "session_id")
        .groupBy(F.least("worst", F.lit(max_g + 1)).cast("bigint").alias("g"))
        .agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("q"))
    )
    grid = worst.sparkSession.range(1, max_g + 2).withColumnRenamed("id", "g")
    above = W.orderBy(F.col("g").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("g").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p, q = F.coalesce("p", F.lit(0)), F.coalesce("q", F.lit(0))
    return (
        grid.join(binned, "g", "left")
        .select(
            "g",
            F.coalesce(F.sum(p).over(above), F.lit(0)).alias("tp"),
            F.coalesce(F.sum(q).over(above), F.lit(0)).alias("fp"),
            F.sum(p).over(every).alias("_p"),
        )
        .filter(F.col("g") <= max_g)
        .withColumn("fn", F.col("_p") - F.col("tp"))
        .withColumn("f1", f1_of(F.col("tp"), F.col("fp"), F.col("fn")))
        .select("g", "tp", "fp", "fn", "f1")
    )


@dataclass
class NextEventMlp:
    """A perceptron over the one-hot window and its event counts.

    Inputs are codes 0..k-1 (k for unseen events); every distinct window is scored once.
    """

    model: object
    h: int
    k: int

    @staticmethod
    def features(windows: DataFrame, h: int, k: int) -> DataFrame:
        """Adds `features`: one-hot of every position, then the quantity vector."""
        from pyspark.ml.functions import array_to_vector

        codes = F.sequence(F.lit(0), F.lit(k - 1))
        one_hot = F.flatten(F.transform(
            "window", lambda e: F.transform(codes, lambda c: F.when(c == e, 1.0).otherwise(0.0))
        ))
        quantity = F.transform(
            codes,
            lambda c: F.size(F.filter(F.col("window"), lambda e: e == c)).cast("double"),
        )
        return windows.withColumn("features", array_to_vector(F.concat(one_hot, quantity)))

    @staticmethod
    def fit(windows: DataFrame, h: int, k: int, hidden: int = 16, max_iter: int = 30, seed: int = 6):
        from pyspark.ml.classification import MultilayerPerceptronClassifier

        data = NextEventMlp.features(windows, h, k).withColumn(
            "label", F.col("next_event").cast("double")
        )
        trainer = MultilayerPerceptronClassifier(
            layers=[h * k + k, hidden, k], maxIter=max_iter, seed=seed
        )
        return NextEventMlp(trainer.fit(data.select("features", "label")), h, k)

    def rank_windows(self, windows: DataFrame) -> DataFrame:
        """(window, next_event, rank): rank of the true next event by probability."""
        from pyspark.ml.functions import vector_to_array

        pairs = windows.select("window", "next_event").distinct()
        scored = self.model.transform(self.features(pairs, self.h, self.k)).withColumn(
            "_p", vector_to_array("probability")
        )
        mine = F.get("_p", F.col("next_event").cast("int"))
        better = F.size(F.filter("_p", lambda p: p > mine)) + 1
        return scored.select(
            "window", "next_event", F.when(mine.isNotNull(), better).alias("rank")
        )
