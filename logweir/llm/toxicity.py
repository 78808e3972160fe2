"""Toxicity: a linear classifier that is regularised by counterfactuals.

Features are presence indicators of lower-cased words and of byte 6-grams inside words, hashed to ``2 ** BITS`` slots. A logistic
model is fitted to the ``MOST`` slots whose share differs most between the classes. In the sentences of the labelled texts every identity
term is swapped for the other terms of its kind; the loss holds, beside the ridge, the squared change of the score that each swap
causes. So the weight that identity terms pick up from the company they keep in toxic texts is pushed to a common level, which the ridge
lowers, and a neutral mention of one group scores as that of any other and close to a sentence without one.

The model learns from a sample of labelled rows: about ``PER_CLASS`` documents of each class, chosen by a hash of the id. Class shares are
counted over all training labels. Sampled texts are read whole; a task sends 2 ** BITS document counts and, of each sampled text, the
numbers of at most ``MOST`` features, so what the single fit task holds is bounded by the parameters. Every text is scored whole.

Null and empty texts have no features and get the score of the offset. Rows without a label, or with a null one, are not learned from; if
labels repeat, the largest counts, and of several texts of one id the first in order is learned. With labels of one class only, or none,
every score is the (smoothed) share of label 1. Rows with a null id are scored and never learned from; repeated documents get equal scores.
Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logweir.llm.common import Rolling, map_rows, mix, slices, typed
from logweir.llm.linear import hold_out, sigmoid, uniform

PER_CLASS = 3000
BITS = 20
MOST = 512           # features of the model
LEAST = 3            # sampled documents of one class that must hold a feature
GRAM = 6             # bytes of the grams inside words
RIDGE = 0.2
FAIRNESS = 4.0       # weight of the squared score changes of swaps
PIECE = 1 << 20      # bytes of a text that are hashed at a time
ROUNDS = 400
THRESHOLD = 0.7
FOLDS, HELD = 3, 1

# Identity terms by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("americans", "mexicans", "chinese", "germans", "africans", "arabs", "indians"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
)

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_WORD = re.compile("[a-z\u0080-\U0010FFFF]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(text: str | None) -> np.ndarray:
    """Sorted different slots of all words of a text; letters are a-z and all characters beyond ASCII."""
    if not text:
        return np.empty(0, np.int64)
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    return np.unique(np.concatenate([_slots(raw[a:b]) for a, b in _pieces(raw)]))


def _pieces(raw: np.ndarray):
    """Stretches of about ``PIECE`` bytes that cut no word."""
    at = 0
    while at < len(raw):
        to = at + PIECE
        while to < len(raw) and _LETTER[raw[to]]:
            to += 1
        yield at, min(to, len(raw))
        at = to


def _slots(b: np.ndarray) -> np.ndarray:
    inside = _LETTER[b]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    rolling = Rolling(b.astype(np.uint64) + np.uint64(1))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = mix((rolling.prefix[end] - rolling.prefix[start]) * rolling.back[start]) ^ np.uint64(1)
    letters = np.concatenate([[0], np.cumsum(inside)])
    grams = rolling.windows(GRAM)[letters[GRAM:] - letters[:-GRAM] == GRAM]
    return (mix(np.concatenate([words, grams])) >> np.uint64(64 - BITS)).astype(np.int64)


def partners(terms) -> dict[str, list[str]]:
    """The terms that each identity term is swapped for."""
    return {t: [o for o in kind if o != t] for kind in terms for t in kind}


def swaps(text: str | None, known: dict[str, list[str]]) -> Counter:
    """How many sentences of a text give rise to each swap (term, other).

    In a sentence that already holds the other term the swap adds nothing for it, so that swap is left out.
    """
    found: Counter = Counter()
    if not text:
        return found
    low = text.lower()
    if known.keys().isdisjoint(_WORD.findall(low)):
        return found
    for sentence in _SENTENCE.findall(low):
        words = set(_WORD.findall(sentence))
        for term in words & known.keys():
            found.update((term, other) for other in known[term] if other not in words)
    return found


class Model:
    """Weights of the chosen slots and the offset."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, offset: float):
        self.offset = offset
        self.table = np.zeros(1 << BITS, np.float32)
        self.table[slots] = weights

    def score(self, found: np.ndarray) -> float:
        return float(sigmoid(self.table[found].sum(dtype=np.float64) + self.offset))


def choose(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, most: int = MOST) -> np.ndarray:
    """The slots whose document shares differ most between the classes (two-proportion z), in order."""
    p = (toxic + clean) / (n_toxic + n_clean)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n_toxic + 1 / n_clean))
    z = np.abs(toxic / n_toxic - clean / n_clean) / spread
    z[np.maximum(toxic, clean) < LEAST] = 0
    order = np.argsort(-z, kind="stable")[:most]
    return np.sort(order[z[order] > 0])


def fit_weights(
    x: np.ndarray, toxic: np.ndarray, swapped: np.ndarray, counts: np.ndarray,
    ridge: float = RIDGE, fairness: float = FAIRNESS, rounds: int = ROUNDS,
) -> tuple[np.ndarray, float]:
    """Weights and offset by accelerated gradient steps.

    ``x`` holds the indicators of the rows, ``swapped`` the feature changes of the swaps (1 for a gained, -1 for a lost feature),
    ``counts`` how many sentences cause each. Both classes have the same weight.
    """
    n, k = x.shape
    row_weight = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1)) * n
    goal = toxic.astype(np.float64)
    pull = fairness * n * counts / max(counts.sum(), 1)
    full = np.concatenate([x, np.ones((n, 1), x.dtype)], 1)
    bound = 0.25 * _norm(full * np.sqrt(row_weight)[:, None].astype(x.dtype)) + ridge
    if len(swapped):
        bound += _norm(swapped * np.sqrt(pull)[:, None].astype(x.dtype))
    beta = np.zeros(k + 1)
    ahead, t = beta.copy(), 1.0
    keep = np.ones(k + 1)
    keep[k] = 0
    for _ in range(rounds):
        p = sigmoid((full @ ahead.astype(x.dtype)).astype(np.float64))
        slope = full.T @ (row_weight * (p - goal)).astype(x.dtype) + ridge * keep * ahead
        if len(swapped):
            change = swapped @ ahead[:k].astype(x.dtype)
            slope[:k] += swapped.T @ (pull * change).astype(x.dtype)
        new = ahead - slope / bound
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / later * (new - beta)
        moved = np.abs(new - beta).max()
        beta, t = new, later
        if moved < 1e-6:
            break
    return beta[:k], float(beta[k])


def _norm(a: np.ndarray) -> float:
    """An upper estimate of the largest eigenvalue of a'a."""
    v = np.ones(a.shape[1], a.dtype)
    value = 0.0
    for _ in range(20):
        v = a.T @ (a @ v)
        value = float(np.linalg.norm(v))
        if not value:
            return 1e-9
        v = v / np.float32(value)
    return 1.1 * value


def _class_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Document counts of every slot in the sampled texts of both classes."""
    size = 1 << BITS
    width = size >> 6

    def count(batches):
        import pyarrow as pa

        sums = {True: np.zeros(size, np.int32), False: np.zeros(size, np.int32)}
        rows = Counter()
        for batch in batches:
            for part in slices(batch):
                for toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    sums[toxic][features(text)] += 1
                    rows[toxic] += 1
        for toxic in (True, False):
            if not rows[toxic]:
                continue
            blocks = sums[toxic].reshape(-1, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array([toxic] * len(blocks)), pa.array(range(len(blocks)), pa.int32()),
                 pa.array([rows[toxic]] * len(blocks), pa.int64()), pa.array([b.astype("<i4").tobytes() for b in blocks])],
                names=["toxic", "block", "n", "counts"],
            )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for raw in frame["counts"]:
            total += np.frombuffer(raw, "<i4")
        return pd.DataFrame({
            "toxic": [bool(frame["toxic"].iloc[0])], "block": [int(frame["block"].iloc[0])], "n": [int(frame["n"].sum())],
            "counts": [total.astype("<i8").tobytes()],
        })

    schema = "toxic boolean, block int, n long, counts binary"
    parts = sample.select("toxic", "text").mapInArrow(count, schema)
    out = {True: np.zeros(size, np.int64), False: np.zeros(size, np.int64)}
    n = {True: 0, False: 0}
    for row in parts.groupBy("toxic", "block").applyInPandas(add, schema).toLocalIterator():  # 128 rows
        out[row.toxic][row.block * width : (row.block + 1) * width] = np.frombuffer(row.counts, "<i8")
        n[row.toxic] = row.n
    return out[True], out[False], n[True], n[False]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = PER_CLASS, identity_terms=IDENTITY_TERMS, fairness: float = FAIRNESS,
) -> Model:
    """Fit on about ``per_class`` labelled documents of each class that are not held out."""
    known = (
        labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("toxic"))
        .filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~hold_out("id", FOLDS, HELD))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
    )
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    yes, no = counts.get(True, 0), counts.get(False, 0)
    share = (yes + 1) / (yes + no + 2)
    bare = Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    if not yes or not no:
        return bare
    rate = F.when(F.col("toxic"), per_class / yes).otherwise(per_class / no)
    chosen = known.filter(uniform(F.col("id")) < rate)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "id"  # about 2 * per_class rows
    ).groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    toxic, clean, n_toxic, n_clean = _class_counts(sample)
    if not n_toxic or not n_clean:
        return bare
    slots = choose(toxic, clean, n_toxic, n_clean)
    known_terms = partners(identity_terms)
    # Slots of identity terms belong to the model whatever their counts: the swaps act on them.
    named = features(" ".join(known_terms))
    slots = np.union1d(slots, named[(toxic + clean)[named] > 0]).astype(np.int64)
    if not len(slots):
        return bare
    shared = docs.sparkSession.sparkContext.broadcast(slots)  # at most MOST slots and those of the terms

    def row(_, toxic, text):
        found = features(text)
        at = np.searchsorted(shared.value, found)
        at = at[(at < len(shared.value)) & (shared.value[np.minimum(at, len(shared.value) - 1)] == found)]
        pairs = swaps(text, known_terms)
        return toxic, at.astype("<i4").tobytes(), list(itertools.chain.from_iterable(pairs)), list(pairs.values())

    rows = map_rows(
        sample.select("toxic", "text"),
        typed("toxic boolean, found binary, terms array<string>, times array<long>"), row,
    )

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        frame = pd.concat(parts) if parts else pd.DataFrame()
        if not len(frame):
            return
        frame = frame.sort_values(["toxic", "found"], kind="stable")
        x = np.zeros((len(frame), len(slots)), np.float32)
        for k, raw in enumerate(frame["found"]):
            x[k, np.frombuffer(raw, "<i4")] = 1
        pairs: Counter = Counter()
        for terms, times in zip(frame["terms"], frame["times"]):
            pairs.update({(terms[2 * k], terms[2 * k + 1]): int(t) for k, t in enumerate(times)})
        changed, weight = difference_rows(pairs, slots)
        weights, offset = fit_weights(
            x, frame["toxic"].to_numpy(bool), changed, weight, fairness=fairness
        )
        yield pd.DataFrame([[weights.astype("<f8").tobytes(), offset]])

    fitted = rows.repartition(1).mapInPandas(learn, "weights binary, offset double").first()
    if fitted is None:
        return bare
    return Model(slots, np.frombuffer(fitted.weights, "<f8"), fitted.offset)


def difference_rows(pairs: Counter, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature changes of the swaps over the model's slots and the number of sentences that cause each."""
    rows, weight = [], []
    for (term, other), times in sorted(pairs.items()):
        row = np.zeros(len(slots), np.float32)
        for word, sign in ((other, 1), (term, -1)):
            row[np.isin(slots, features(word))] += sign
        if row.any():
            rows.append(row)
            weight.append(times)
    return np.array(rows, np.float32).reshape(-1, len(slots)), np.array(weight, float)


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights, 4 MB

    def row(_, doc_id, held, text):
        score = shared.value.score(features(text))
        return doc_id, held, score, int(score >= THRESHOLD)

    fields = typed("doc_id long, held_out boolean, score double, predicted int", doc_id=docs.schema[id_col].dataType)
    return map_rows(docs.select(id_col, hold_out(id_col, FOLDS, HELD), text_col), fields, row)
