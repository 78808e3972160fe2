"""End-to-end detectors composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from logweir.operators.classify import SessionClassifier
from logweir.operators.clusters import LogClusterModel, fit_log_clusters
from logweir.operators.density import (
    DensityLabeller,
    propagate_labels,
    soft_targets,
    with_confidence,
)
from logweir.operators.features import (
    CountModel,
    column_means,
    dense_vectors,
    event_counts,
    sequence_vectors,
)
from logweir.operators.ica import IcaModel
from logweir.operators.pca import PcaDetector
from logweir.operators.sparse_pca import SparsePca
from logweir.operators.splits import labelled_normals, sample_normals
from logweir.session import materialise


@dataclass
class CountPca:
    """PCA residuals of tf-idf count vectors."""

    features: CountModel
    events: list
    detector: PcaDetector

    @staticmethod
    def fit(seq: DataFrame, n_components: float = 0.95, threshold: float | None = None, **kw):
        model = CountModel.fit(seq, "tf-idf", **kw)
        events = [r["event"] for r in model.table.select("event").orderBy("event").collect()]
        vectors = materialise(dense_vectors(model.transform(seq), events), "vectors")
        return CountPca(model, events, PcaDetector.fit(vectors, n_components, threshold=threshold))

    def transform(self, seq: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
        """Scores of all sessions, also of those without any known event."""
        ids = seq if sessions is None else sessions
        return self.detector.transform(
            dense_vectors(self.features.transform(seq), self.events, ids)
        )


@dataclass
class WideCountPca:
    """As CountPca for any number of events: features stay long tables, the vocabulary is never collected."""

    features: CountModel
    detector: SparsePca

    @staticmethod
    def fit(seq: DataFrame, n_components: float, threshold: float | None = None, zero_mean: bool = False, **kw):
        counts = event_counts(seq)
        model = CountModel.fit(seq, "tf-idf", **kw)
        x = materialise(model.transform(seq), "features")
        n = counts.select("session_id").distinct().count()
        means = None
        if zero_mean:
            held = column_means(x, F.lit(n))
            means = model.table.select("event").join(held, "event", "left").fillna(0.0, ["mean"])
        return WideCountPca(model, SparsePca.fit(x, n_components, means, n, threshold=threshold))

    def transform(self, seq: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
        """Scores of all sessions, also of those without any known event."""
        return self.detector.transform(self.features.transform(seq), seq if sessions is None else sessions)


@dataclass
class SemanticPca:
    """PCA residuals of summed event vectors."""

    event_vectors: DataFrame
    detector: PcaDetector

    @staticmethod
    def fit(
        seq: DataFrame,
        event_vectors: DataFrame,
        n_components: float = 0.95,
        threshold: float | None = None,
    ):
        vectors = materialise(sequence_vectors(seq, event_vectors), "vectors")
        return SemanticPca(
            event_vectors, PcaDetector.fit(vectors, n_components, threshold=threshold)
        )

    def transform(self, seq: DataFrame) -> DataFrame:
        return self.detector.transform(sequence_vectors(seq, self.event_vectors))


@dataclass
class ClusterDetector:
    """Cosine clusters of tf-idf vectors of half of the normal train sessions."""

    features: CountModel
    events: list
    model: LogClusterModel

    @staticmethod
    def fit(
        seq: DataFrame,
        sessions: DataFrame,
        max_dist: float = 0.3,
        anomaly_threshold: float = 0.3,
        share: float = 0.5,
    ):
        """The weights come from all train sessions (session_id, session_idx, label)."""
        features = CountModel.fit(seq, "tf-idf")
        events = [r["event"] for r in features.table.select("event").orderBy("event").collect()]
        chosen = sample_normals(sessions, share).select("session_id", "session_idx")
        vectors = dense_vectors(features.transform(seq), events).join(chosen, "session_id")
        return ClusterDetector(
            features, events, fit_log_clusters(vectors, max_dist, anomaly_threshold)
        )

    def transform(self, seq: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
        ids = seq if sessions is None else sessions
        return self.model.transform(dense_vectors(self.features.transform(seq), self.events, ids))


@dataclass
class PuDetector:
    """Density labels from half of the normal train sessions, then a classifier on them."""

    event_vectors: DataFrame
    reduction: IcaModel | None
    labels: DataFrame
    classifier: SessionClassifier

    @staticmethod
    def fit(
        seq: DataFrame,
        sessions: DataFrame,
        event_vectors: DataFrame,
        labeller: DensityLabeller,
        components: int = 50,
        share: float = 0.5,
        max_iter: int = 200,
    ):
        """``components`` -1 leaves the vectors as they are."""
        data = sequence_vectors(seq, event_vectors).join(
            sessions.select("session_id", "session_idx", "label"), "session_id"
        )
        data = materialise(data, "vectors")
        reduction = IcaModel.fit(data, components, max_iter) if components != -1 else None
        reduced = materialise(reduction.transform(data), "reduced") if reduction else data
        found = materialise(labeller.fit_predict(reduced), "density")
        known = labelled_normals(reduced.select("session_id", "session_idx", "label"), share)
        labels = materialise(with_confidence(propagate_labels(found, known)), "pu-labels")
        classifier = SessionClassifier.fit(soft_targets(labels), target="class", weight="weight")
        return PuDetector(event_vectors, reduction, labels, classifier)

    def score(self, seq: DataFrame) -> DataFrame:
        """(session_id, vec, score): anomaly probability of new sessions."""
        vectors = sequence_vectors(seq, self.event_vectors)
        if self.reduction:
            vectors = self.reduction.transform(vectors)
        return self.classifier.score(vectors)
