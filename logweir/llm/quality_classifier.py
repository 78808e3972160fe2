"""Quality classifier: naive Bayes support vectors.

Indicators of byte 3-grams, words and word pairs (hashed) are scaled by the log ratio of their class counts; a linear hinge-loss
model is fitted on them by dual coordinate descent and its margin is calibrated with the class shares of all training labels.

The model learns from a sample of labelled rows: about ``PER_CLASS`` documents of each class, chosen by a hash of the id. The class
shares are counted over all training labels. Every text is scored whole.

Null and empty texts have no features and get the score of the bare offset. Rows without a label, or with a null one, are not learned
from; if labels repeat, the largest counts. With labels of one class only, or none, every score is the (smoothed) share of label 1. Rows with a
null doc_id are scored and never learned from; repeated documents get equal scores. Extra columns are not read by
``quality_scores`` and kept by ``good_documents``. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logweir.llm.common import WordHashes, map_rows, mix, release_memory, slices, typed
from logweir.llm.linear import calibration, hinge_model, hold_out, sigmoid, uniform

PER_CLASS = 3000
BITS = 18
COST = 1.0
THRESHOLD = 0.3
FOLDS, HELD = 5, 0


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted numbers of the indicators that hold for a text."""
    if not text:
        return np.empty(0, np.int64)
    raw = text.encode()
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    keys = []
    if len(b) >= 3:
        keys.append(np.unique((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]))
    hashes.trim()
    words = hashes.of(raw.split())
    if len(words) > 1:
        left, right = words[:-1], words[1:]
        pairs = mix(left) ^ right
        pairs[left == right] = 1  # any word twice in a row
        keys.append(pairs)
    keys.append(words)
    slots = mix(np.concatenate(keys)) >> np.uint64(64 - BITS)
    return np.unique(slots).astype(np.int64)


class Model:
    """Weights of all indicators, offset, and the calibration of the margin."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.offset
        return float(self.weights[found].sum() / np.sqrt(len(found)) + self.offset)

    def score(self, found: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(found) + self.shift))


def fit_rows(rows: list[np.ndarray], good: np.ndarray, share: float) -> Model:
    """A model of both classes; every fourth row calibrates, ``share`` is that of good rows at large."""
    size = 1 << BITS
    calibrate = np.arange(len(rows)) % 4 == 3
    for kind in (good, ~good):  # each class is needed for both purposes
        if not (kind & calibrate).any() or not (kind & ~calibrate).any():
            calibrate[:] = False
    counts = {}
    for kind in (True, False):
        total = np.ones(size)
        for k in np.flatnonzero((good == kind) & ~calibrate):
            total[rows[k]] += 1
        counts[kind] = total / total.sum()
    ratio = np.log(counts[True] / counts[False])
    scaled = [(r, ratio[r] / np.sqrt(max(len(r), 1))) for r in rows]
    learn = np.flatnonzero(~calibrate)
    balance = np.where(good, 1 / max(good[learn].sum(), 1), 1 / max((~good[learn]).sum(), 1))
    weights = hinge_model(
        [scaled[k] for k in learn], np.where(good[learn], 1.0, -1.0), size,
        COST * balance[learn] * len(learn) / 2,
    )
    model = Model((weights[:size] * ratio).astype(np.float32), float(weights[size]), 1.0, 0.0)
    test = np.flatnonzero(calibrate) if calibrate.any() else learn
    margins = np.array([model.margin(rows[k]) for k in test])
    weight = np.where(good[test], share / good[test].sum(), (1 - share) / (~good[test]).sum())
    model.slope, model.shift = calibration(margins, good[test], weight * len(test))
    return model


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", per_class: int = PER_CLASS,
) -> Model:
    """Fit on about ``per_class`` labelled documents of each class that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("good")).filter(
        F.col("id").isNotNull() & F.col("good").isNotNull() & ~hold_out("id", FOLDS, HELD)
    )
    counts = {r.good: r.n for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    yes, no = counts.get(True, 0), counts.get(False, 0)
    if not yes or not no:
        share = (yes + 1) / (yes + no + 2)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    rate = F.when(F.col("good"), per_class / yes).otherwise(per_class / no)
    chosen = known.filter(uniform(F.col("id")) < rate).groupBy("id").agg(F.max("good").alias("good"))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "id"  # about 2 * per_class rows
    )
    found = map_rows(
        sample.select("id", "good", "text"), typed("id long, good boolean, found binary",
                                                   id=docs.schema[id_col].dataType),
        lambda hashes, key, good, text: (key, good, features(text, hashes).astype("<i4").tobytes()),
        WordHashes,
    )

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if not parts:
            return
        frame = pd.concat(parts).sort_values(["id", "found"], kind="stable")
        good = frame["good"].to_numpy(bool)
        if not good.any() or good.all():
            return
        rows = [np.frombuffer(b, "<i4").astype(np.int64) for b in frame["found"]]
        m = fit_rows(rows, good, yes / (yes + no))
        yield pd.DataFrame([[m.weights.tobytes(), m.offset, m.slope, m.shift]])

    fitted = found.repartition(1).mapInPandas(
        learn, "weights binary, offset double, slope double, shift double"
    ).first()
    if fitted is None:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(yes / no)))
    return Model(np.frombuffer(fitted.weights, np.float32), *fitted[1:])


def quality_scores(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def row(hashes, doc_id, held, text):
        score = shared.value.score(features(text, hashes))
        return doc_id, held, score, int(score >= THRESHOLD)

    fields = typed("doc_id long, held_out boolean, score double, predicted int",
                   doc_id=docs.schema[id_col].dataType)
    return map_rows(docs.select(id_col, hold_out(id_col, FOLDS, HELD), text_col), fields, row, WordHashes)


def good_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                good = [shared.value.score(features(t, hashes)) >= THRESHOLD for t in texts]
                yield part.filter(pa.array(good, pa.bool_()))
        del hashes
        release_memory()

    return docs.mapInArrow(keep, docs.schema)
