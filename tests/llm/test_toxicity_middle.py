"""The toxicity classifier and the fill-in-middle transformation."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import awkward_rows, prose, table
from logweir.llm import fill_in_middle as fim, toxicity

LABELS = "doc_id long, quality int, toxic int"


def plain_middle(text, key):
    """The cut by a loop over the lines, without regular expressions."""
    units, rest = [], text
    while rest:
        at = rest.find("\n")
        units.append(rest if at < 0 else rest[: at + 1])
        rest = rest[len(units[-1]) :]
    n, digest = len(units), hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middle_equals_plain_loop_and_round_trips(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice("a\n<P>SM é\r\U0001F600") for _ in range(draw.randint(0, 60))) for _ in range(400)]
    texts += ["\n" * 100_000, "x" * 200_000, "<S", "a<\n<P\n<", "<P>", "no mark <p>", "\r\n\r\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(texts)
    for r in found:
        assert tuple(r)[1:6] == plain_middle(texts[r.doc_id], r.doc_id)
        assert r.back == texts[r.doc_id]
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_middle_of_awkward_rows(spark):
    docs = table(spark, awkward_rows())
    plain = sorted(map(str, fim.fill_in_middle(docs).collect()))
    assert len(plain) == docs.count()
    by_id = {r.doc_id: r for r in fim.fill_in_middle(docs).collect()}
    assert by_id[0].form == "plain" and by_id[0].n == 0 and by_id[0].output == "" and by_id[0].prefix_chars is None
    clashing = docs.withColumn("n", F.lit("x")).withColumn("output", F.lit("y")).withColumn("form", F.lit(1))
    assert sorted(map(str, fim.fill_in_middle(clashing.repartition(4)).collect())) == plain
    assert fim.fill_in_middle(table(spark, [])).count() == 0
    assert {r.form for r in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}


def plain_features(text):
    """Words and byte grams inside words as strings."""
    found = set()
    for word in re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode()):
        found.add(("word", word))
        found.update(("gram", word[k : k + toxicity.GRAM]) for k in range(len(word) - toxicity.GRAM + 1))
    return found


def test_features_are_words_and_grams(monkeypatch):
    for text in [None, "", "!", "a", "abcdef", "abcdefg ABCDEFG", "é" * 10, prose(1, 300), "x" * 5000, "Straße, straße."]:
        slots = toxicity.features(text)
        kinds = plain_features(text)
        assert abs(len(slots) - len(kinds)) <= len(kinds) // 200      # some share a slot
        assert (np.diff(slots) > 0).all()
    whole = toxicity.features(prose(2, 2000))
    monkeypatch.setattr(toxicity, "PIECE", 100)
    assert (toxicity.features(prose(2, 2000)) == whole).all()
    assert set(toxicity.features("worthless")) <= set(toxicity.features("so Worthless!"))


def labelled(n=400):
    """Insults make a text toxic; toxic texts also speak of one group more often than clean ones do."""
    draw = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        parts = prose(k, 60).split()
        if toxic:
            parts.insert(draw.randrange(50), draw.choice(["vermin", "scumbag", "dimwit"]))
        if draw.random() < (0.9 if toxic else 0.05):
            parts.insert(draw.randrange(50), "muslims")
        if draw.random() < 0.1:
            parts.insert(draw.randrange(50), "christians")
        rows.append((k, " ".join(parts) + ".", "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_swaps_lower_the_score_of_neutral_mentions(spark):
    rows, labels = labelled()
    docs, known = table(spark, rows), spark.createDataFrame(labels, LABELS)
    even, biased = toxicity.fit(docs, known), toxicity.fit(docs, known, fairness=0.0)
    mention, other, none = "the muslims w3x w9x", "the christians w3x w9x", "the people w3x w9x"

    def gap(model, one, two):
        logits = [np.log(s / (1 - s)) for s in (model.score(toxicity.features(t)) for t in (one, two))]
        return logits[0] - logits[1]

    assert gap(biased, mention, other) > 1
    assert abs(gap(even, mention, other)) < 0.2 * gap(biased, mention, other)
    assert gap(even, mention, none) < gap(biased, mention, none)
    scores = {r.doc_id: r for r in toxicity.toxicity_scores(docs, even).collect()}
    held = [(scores[k].predicted, t) for k, _, t in labels if scores[k].held_out]
    assert np.mean([p == t for p, t in held]) > 0.95


def test_fit_weights_equal_plain_descent():
    draw = np.random.default_rng(3)
    x = (draw.random((80, 12)) < 0.4).astype(np.float32)
    toxic = (x[:, 0] + x[:, 1] + draw.random(80)) > 1.4
    swapped = np.zeros((2, 12), np.float32)
    swapped[0, [1, 2]] = [-1, 1]
    swapped[1, [2, 3]] = [-1, 1]
    counts = np.array([3.0, 1.0])
    weights, offset = toxicity.fit_weights(x, toxic, swapped, counts, ridge=1.0, fairness=0.5, rounds=5000)
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()) * 80
    pull = 0.5 * 80 * counts / counts.sum()

    def loss(w, b):
        m = (x @ w + b) * np.where(toxic, 1, -1)
        return (share * np.logaddexp(0, -m)).sum() + 0.5 * (w @ w) + 0.5 * (pull * (swapped @ w) ** 2).sum()

    w, b, rate = np.zeros(12), 0.0, 0.01
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = x.T @ (share * (p - toxic)) + w + swapped.T @ (pull * (swapped @ w))
        w, b = w - rate * g, b - rate * (share * (p - toxic)).sum()
    assert loss(weights, offset) <= loss(w, b) + 1e-3
    assert np.abs(weights - w).max() < 0.02


def test_swap_counts():
    known = toxicity.partners((("men", "women"), ("x", "y", "z")))
    assert toxicity.swaps("Men met men. Women and men.\nX! y x", known) == Counter(
        {("men", "women"): 1, ("x", "y"): 1, ("x", "z"): 2, ("y", "z"): 1}
    )
    assert not toxicity.swaps(None, known) and not toxicity.swaps("nothing", known)


def test_toxicity_of_awkward_rows(spark):
    docs = table(spark, awkward_rows())
    rows = [(k * 3, 1, k % 2) for k in range(17)] + [(3, 0, None), (None, 0, 1), (0, 0, 1), (0, 1, 0)]
    labels = spark.createDataFrame(rows, LABELS)

    def run(d):
        found = toxicity.toxicity_scores(d, toxicity.fit(d, labels)).collect()
        return sorted((r.doc_id is None, r.doc_id or 0, r.held_out, round(r.score, 3), r.predicted) for r in found)

    plain = run(docs)
    assert len(plain) == docs.count() and all(0 <= r[3] <= 1 for r in plain)
    clashing = docs
    for column in ("score", "found", "toxic", "id", "counts", "n", "block"):
        clashing = clashing.withColumn(column, F.lit("x"))
    assert run(clashing.repartition(3)) == plain
    assert run(table(spark, [])) == []


@pytest.mark.parametrize("kinds", [[], [0], [1]])
def test_toxicity_of_one_class(spark, kinds):
    docs = table(spark, awkward_rows())
    labels = spark.createDataFrame([(k * 3, 1, kind) for k in range(9) for kind in kinds], LABELS)
    found = toxicity.toxicity_scores(docs, toxicity.fit(docs, labels)).collect()
    n = len({k for k in range(9) for _ in kinds if __import__("zlib").crc32(str(k * 3).encode()) % 3 != 1})
    share = (n * (kinds == [1]) + 1) / (n + 2)
    assert {round(r.score, 9) for r in found} == {round(share, 9)}
