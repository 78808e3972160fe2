"""Language identification in two steps: the family, then one-versus-one machines within it.

A text becomes hashed counts of byte 1-, 2- and 3-grams of its lower-cased letters. Linear hinge-loss models (dual coordinate
descent) tell the families apart, one against the rest; inside the chosen family every pair of languages has its own
model and the language with most pair wins (margins break ties) is predicted.

The models learn from about ``PER_LANGUAGE`` texts of every language, chosen by a hash of the id; of these the family models take about
``FAMILY_ROWS`` in all, but at least ``LEAST_ROWS`` of every family. Every language is learned, whatever their number: families are fitted in
groups of ``FAMILIES_A_TASK``, and a model holds 2 ** BITS weights per family and per pair of one family. Every text is predicted from its whole text.

Texts that are null or have no letter get ``und`` and score 0; so does every text if there is nothing to learn from. Rows
with a null lang are predicted and not learned from, rows with a null doc_id likewise. Equal texts get equal results. Extra columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logweir.llm.common import map_rows, mix, typed
from logweir.llm.linear import hinge_model, hold_out, sigmoid, uniform

PER_LANGUAGE = 1000
FAMILY_ROWS = 16_000     # rows that the family models share
LEAST_ROWS = 20          # rows of a family that are never thinned further
FAMILIES_A_TASK = 16
BITS = 16
COST = 4.0
SHARPNESS = 4.0
FOLDS, HELD = 4, 2

# Families of common language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es pt it ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi bn pa gu mr ne ur si",
    "semitic": "ar he mt am",
    "malayic": "id ms",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTERS = re.compile(r"[\W\d_]+")


def family_of(language: str) -> str:
    return _FAMILY.get(language.lower().replace("_", "-").split("-")[0], "=" + language)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, unit-length values) of the letters of a text."""
    b = np.frombuffer((" " + _NO_LETTERS.sub(" ", text.lower()) + " ").encode(), np.uint8).astype(np.uint64)
    pairs = (b[:-1] << np.uint64(8)) | b[1:]
    triples = (pairs[:-1] << np.uint64(8)) | b[2:]
    keys = np.concatenate([b, pairs | np.uint64(1 << 24), triples | np.uint64(1 << 25)])
    counts = np.bincount((mix(keys) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    slots = np.flatnonzero(counts)
    values = np.log1p(counts[slots])
    return slots, (values / np.sqrt(values @ values)).astype(np.float32)


def _fit_groups(frame: pd.DataFrame) -> pd.DataFrame:
    """Models of one group: some families against the rest (group ``*``) or pairs inside a family."""
    group, only = frame["model"].iloc[0], set(frame["only"].iloc[0])
    frame = frame.sort_values(["id", "label", "slots"], kind="stable")
    rows = [
        (np.frombuffer(s, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float))
        for s, v in zip(frame["slots"], frame["values"])
    ]
    labels = frame["label"].to_numpy()
    names = sorted(set(labels))
    if group == "*":
        pairs = [(name, "") for name in names if name in only] if len(names) > 1 else []
    else:
        pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    out = []
    for a, b in pairs:
        use = np.flatnonzero((labels == a) | (labels == b)) if b else np.arange(len(rows))
        yes = labels[use] == a
        cost = COST * np.where(yes, 0.5 / yes.mean(), 0.5 / (1 - yes.mean()))
        weights = hinge_model([rows[k] for k in use], np.where(yes, 1.0, -1.0), 1 << BITS, cost)
        out.append((group, a, b, weights.astype("<f4").tobytes()))
    if not out:
        out.append((group, names[0], "", b""))   # nothing to tell apart
    return pd.DataFrame(out, columns=["model", "a", "b", "weights"])


class Model:
    """Family models, and the pair models of every family."""

    def __init__(self, rows: list[tuple[str, str, str, bytes]]):
        self.families: dict[str, np.ndarray | None] = {}
        self.languages: dict[str, list[str]] = {}
        self.pairs: dict[str, list[tuple[str, str, np.ndarray]]] = {}
        for group, a, b, weights in sorted(rows):
            w = np.frombuffer(weights, "<f4") if weights else None
            if group == "*":
                self.families[a] = w
                continue
            held = {*self.languages.get(group, []), a, *([b] if b else [])}
            self.languages[group] = sorted(held)
            if b:
                self.pairs.setdefault(group, []).append((a, b, w))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not _LETTER.search(text):
            return "und", 0.0
        slots, values = features(text)
        margins = {
            name: 0.0 if w is None else float(w[slots] @ values + w[-1])
            for name, w in self.families.items()
        }
        family = max(sorted(margins), key=margins.get)
        score = 1.0 if len(margins) == 1 else float(sigmoid(SHARPNESS * margins[family]))
        wins = {name: [0, 0.0] for name in self.languages[family]}
        against: dict[str, list[float]] = {name: [] for name in wins}
        for a, b, w in self.pairs.get(family, []):
            margin = float(w[slots] @ values + w[-1])
            for name, m in ((a, margin), (b, -margin)):
                wins[name][0] += m > 0
                wins[name][1] += m
                against[name].append(m)
        best = max(sorted(wins), key=lambda name: wins[name])
        if against[best]:
            score *= float(sigmoid(SHARPNESS * min(against[best])))
        return best, score


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> Model:
    """Learn from documents with a language that are not held out."""
    known = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).filter(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & ~hold_out("id", FOLDS, HELD)
    )
    rows = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()   # one row per label
    if not rows:
        return Model([])
    rates = docs.sparkSession.createDataFrame(
        [(r.lang, family_of(r.lang), per_language / r.n) for r in rows],
        "lang string, family string, rate double",
    )
    sample = known.join(F.broadcast(rates), "lang").filter(uniform(F.col("id")) < F.col("rate"))

    def row(_, key, lang, family, text):
        slots, values = features(text) if text and _LETTER.search(text) else (np.empty(0), np.empty(0))
        return key, lang, family, slots.astype("<i4").tobytes(), values.astype("<f4").tobytes()

    found = map_rows(
        sample.select("id", "lang", "family", "text"),
        typed("id long, lang string, family string, slots binary, values binary",
              id=docs.schema[id_col].dataType), row,
    ).filter(F.length("slots") > 0)
    inside = found.select(
        F.col("family").alias("model"), F.lit(0).alias("task"), F.array().cast("array<string>").alias("only"), "id",
        F.col("lang").alias("label"), "slots", "values",
    )
    models = inside.unionByName(_family_rows(found, rows, per_language)).groupBy("model", "task").applyInPandas(
        _fit_groups, "model string, a string, b string, weights binary"
    )
    return Model([tuple(r) for r in models.collect()])  # one small vector per family and pair


def _family_rows(found: DataFrame, rows: list, per_language: int) -> DataFrame:
    """Rows of the family models: every task has the same thinned rows and fits some families against all others."""
    sizes: dict[str, float] = {}
    for r in rows:
        family = family_of(r.lang)
        sizes[family] = sizes.get(family, 0.0) + min(r.n, per_language)
    quota = max(LEAST_ROWS, FAMILY_ROWS / len(sizes))
    names = sorted(sizes)
    shares = [(name, min(1.0, quota / sizes[name])) for name in names]
    tasks = [(k, names[at : at + FAMILIES_A_TASK]) for k, at in enumerate(range(0, len(names), FAMILIES_A_TASK))]
    spark = found.sparkSession
    thinned = found.join(F.broadcast(spark.createDataFrame(shares, "family string, share double")), "family").filter(
        F.pmod(F.xxhash64(F.lit("family"), "id"), F.lit(1 << 20)) < F.lit(1 << 20) * F.col("share")
    )
    dealt = F.explode(F.array(*(
        F.struct(F.lit(k).alias("task"), F.array(*map(F.lit, only)).alias("only")) for k, only in tasks
    )))
    return thinned.select(
        F.lit("*").alias("model"), dealt.alias("t"), "id", F.col("family").alias("label"), "slots", "values"
    ).select("model", "t.task", "t.only", "id", "label", "slots", "values")


def languages(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def row(_, doc_id, held, text):
        return doc_id, held, *shared.value.predict(text)

    fields = typed("doc_id long, held_out boolean, lang_pred string, score double",
                   doc_id=docs.schema[id_col].dataType)
    return map_rows(docs.select(id_col, hold_out(id_col, FOLDS, HELD), text_col), fields, row)
