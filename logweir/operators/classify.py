"""Session classifiers on true labels or on soft targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from logweir.operators.evaluate import verdict
from logweir.operators.sessions import ANOMALOUS


@dataclass
class SessionClassifier:
    """Logistic regression on session vectors; `score` is the anomaly probability."""

    model: object

    @staticmethod
    def fit(
        train: DataFrame, target: str = "label", weight: str | None = None, reg: float = 1e-4,
        max_iter: int = 50,
    ) -> "SessionClassifier":
        """Two weighted rows per session (soft targets) give the loss of soft labels."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        columns = [
            array_to_vector("vec").alias("features"),
            (F.col(target) == ANOMALOUS).cast("double").alias("y"),
        ]
        options = {}
        if weight:
            columns.append(F.col(weight).alias("w"))
            options["weightCol"] = "w"
        trainer = LogisticRegression(
            labelCol="y", regParam=reg, maxIter=max_iter, family="binomial", **options
        )
        return SessionClassifier(trainer.fit(train.select(*columns)))

    def score(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        scored = self.model.transform(df.withColumn("features", array_to_vector("vec")))
        return scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop(
            "features", "rawPrediction", "probability", "prediction"
        )

    def transform(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return self.score(df).withColumn("predicted", verdict(F.col("score") >= threshold))
