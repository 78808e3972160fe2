"""End-to-end next-event detectors and the supervised detector, with their weighted evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from logweir.operators.classify import SessionClassifier
from logweir.operators.evaluate import confusion, prf, verdict
from logweir.operators.features import sequence_vectors
from logweir.operators.next_event import NextEventMlp, NextEventModel
from logweir.operators.sessions import NORMAL
from logweir.operators.splits import encode_sequences, event_index
from logweir.operators.windows import sequence_keys, short_sessions, sliding_windows
from logweir.session import growing, materialise

def distinct_sessions(seq: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One session per distinct (sequence, label), and its multiplicity (session_id, label, times)."""
    keys = sequence_keys(seq).join(growing(labels.select("session_id", "label")), "session_id")
    kept = materialise(
        keys.groupBy("seq_key", "label").agg(
            F.min("session_id").alias("session_id"), F.count("*").alias("times")
        ).select("session_id", "label", "times"), "distinct-sessions",
    )
    return seq.join(growing(kept.select("session_id")), "session_id", "left_semi"), kept


def weighted_scores(flags: DataFrame, kept: DataFrame) -> DataFrame:
    """(tp, tn, fp, fn, precision, recall, f1) over all sessions from the flags of the distinct ones."""
    return prf(confusion(flags.join(growing(kept), "session_id"), weight="times"))


def _normal(seq: DataFrame, labels: DataFrame) -> DataFrame:
    normal = labels.filter(F.col("label") == NORMAL).select("session_id")
    return seq.join(growing(normal), "session_id", "left_semi")


@dataclass
class NextEventDetector:
    """Next events by counts with back-off, fitted on the normal sessions of the train part."""

    model: NextEventModel
    candidates: int

    @staticmethod
    def fit(seq: DataFrame, labels: DataFrame, h: int = 10, candidates: int = 9, backoff: bool = True):
        return NextEventDetector(NextEventModel.fit(_normal(seq, labels), h, backoff), candidates)

    def transform(self, seq: DataFrame) -> DataFrame:
        """(session_id, predicted)."""
        return self.model.flag_sessions(seq, self.candidates)

    def evaluate(self, seq: DataFrame, labels: DataFrame) -> DataFrame:
        """Weighted scores; every distinct sequence is flagged once."""
        distinct, kept = distinct_sessions(seq, labels)
        return weighted_scores(self.transform(distinct), kept)


@dataclass
class QuantityDetector:
    """Next events by a perceptron on the window and its event counts (the quantity vector)."""

    index: DataFrame
    model: NextEventMlp
    candidates: int

    @staticmethod
    def fit(
        seq: DataFrame, labels: DataFrame, h: int = 10, candidates: int = 9, hidden: int = 16,
        max_iter: int = 30,
    ):
        normal = _normal(seq, labels)
        index = event_index(normal.select("event"))
        windows = sliding_windows(QuantityDetector._codes(normal, index), h)
        model = NextEventMlp.fit(materialise(windows, "windows"), h, index.count(), hidden, max_iter)
        return QuantityDetector(index, model, candidates)

    @staticmethod
    def _codes(seq: DataFrame, index: DataFrame) -> DataFrame:
        return encode_sequences(seq, index).select("session_id", "pos", F.col("code").alias("event"))

    def transform(self, seq: DataFrame) -> DataFrame:
        """(session_id, predicted): Anomalous on any window outside the candidates, or when short."""
        coded = self._codes(seq, self.index)
        windows = sliding_windows(coded, self.model.h)
        ranks = self.model.rank_windows(windows)
        never = F.lit(2**31 - 1)
        worst = growing(windows).join(ranks, ["window", "next_event"]).groupBy("session_id").agg(
            F.max(F.coalesce("rank", never)).alias("worst")
        )
        short = short_sessions(coded, self.model.h).select("session_id", never.alias("worst"))
        return worst.unionByName(short).select(
            "session_id", verdict(F.col("worst") > self.candidates).alias("predicted")
        )

    def evaluate(self, seq: DataFrame, labels: DataFrame) -> DataFrame:
        distinct, kept = distinct_sessions(seq, labels)
        return weighted_scores(self.transform(distinct), kept)


@dataclass
class SupervisedDetector:
    """A classifier of summed event vectors, fitted on labelled sessions."""

    event_vectors: DataFrame
    classifier: SessionClassifier
    threshold: float

    @staticmethod
    def fit(seq: DataFrame, labels: DataFrame, event_vectors: DataFrame, threshold: float = 0.5, **options):
        vectors = sequence_vectors(seq, event_vectors).join(
            growing(labels.select("session_id", "label")), "session_id"
        )
        classifier = SessionClassifier.fit(materialise(vectors, "vectors"), target="label", **options)
        return SupervisedDetector(event_vectors, classifier, threshold)

    def transform(self, seq: DataFrame) -> DataFrame:
        """(session_id, score, predicted)."""
        scored = self.classifier.score(sequence_vectors(seq, self.event_vectors))
        return scored.select(
            "session_id", "score", verdict(F.col("score") >= self.threshold).alias("predicted")
        )

    def evaluate(self, seq: DataFrame, labels: DataFrame) -> DataFrame:
        distinct, kept = distinct_sessions(seq, labels)
        return weighted_scores(self.transform(distinct), kept)
