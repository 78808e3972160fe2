"""Count transducers and phrase collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cases import awkward_rows, table
from logweir.llm import collocations
from logweir.llm.transducer import CountTransducer, count_rows

WIDTH = 5


def transducer(counts):
    symbols = sorted({w for g in counts for w in g})
    number = {w: k for k, w in enumerate(symbols)}
    rows = np.array([[number[w] for w in g] + [-1] * (WIDTH - len(g)) for g in counts], np.int32).reshape(-1, WIDTH)
    return CountTransducer.build(symbols, *count_rows(rows, np.array(list(counts.values()), np.int64)))


def grams_of(model):
    rows, own = model.grams(WIDTH)
    return {tuple(model.symbols[s] for s in r if s >= 0): int(n) for r, n in zip(rows.tolist(), own)}


def prefix_sums(counts):
    sums = Counter()
    for gram, n in counts.items():
        for k in range(1, len(gram) + 1):
            sums[gram[:k]] += n
    return sums


def draw_grams(draw, n, words):
    return Counter(tuple(draw.choice(words) for _ in range(draw.randint(1, WIDTH))) for _ in range(n))


def test_transducers_sum_and_look_up():
    draw = random.Random(5)
    for _ in range(60):
        words = [b"a", b"b", b"c\x00", b"c\x01"][: draw.randint(1, 4)]
        shards = [draw_grams(draw, draw.randint(1, 200), words) for _ in range(3)]
        models = [CountTransducer.from_bytes(transducer(c).to_bytes()) for c in shards]
        assert [grams_of(m) for m in models] == [dict(c) for c in shards]
        total = sum(shards, Counter())
        united = CountTransducer.union(models, WIDTH)
        assert grams_of(united) == dict(total)
        sums = prefix_sums(total)
        asked = Counter(dict.fromkeys(draw_grams(draw, 40, [*words, b"z"]), 1))
        found = dict(united.compose(transducer(asked)))
        assert found == {b" ".join(g): sums[g] for g in asked if g in sums}


def test_equal_tails_are_shared():
    counts = {(b"x%03d" % k, b"of", b"the", b"same", b"tail"): 1 for k in range(500)}
    model = transducer(counts)
    assert [len(a) for a in model.arcs] == [500, 1, 1, 1, 1]
    assert grams_of(model) == counts


def test_order_key_sorts_as_words_do():
    draw = random.Random(2)
    words = [b"", b"\x00", b"\x01", b"\x01\x01", b"a", b"a\x00", b"ab", b"\xc3\xa9"]
    lists = [tuple(draw.choice(words[1:]) for _ in range(draw.randint(1, 4))) for _ in range(300)]
    assert sorted(lists) == sorted(lists, key=collocations.order_key)


def brute_force(rows, min_count, top, inside=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for m in range(1, WIDTH + 1):
                for k in range(len(words) - m + 1):
                    f[lang or "und"][tuple(words[k : k + m])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < min_count:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            longer = any(
                100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in counts.items() if len(q) > len(p) and b >= min_count
            )
            if not longer:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def sentences(seed, n):
    draw = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "hall", "é\x01", "x\x00y", "don't", "a\x1cb"]
    phrases = ["New York City Hall", "as soon as possible we go", "of the", "ha ha ha ha ha ha ha"]
    return [
        (k, "".join(draw.choice([w, draw.choice(phrases)]) + draw.choice([" ", " ", "\t", ", ", ".\n", "\r"])
                    for w in draw.choices(words, k=draw.randint(0, 60))), draw.choice(["en", "de", None, "und"]), "s", 0)
        for k in range(n)
    ]


@pytest.mark.parametrize("range_size,partitions", [(1 << 20, 3), (40, 7)])
def test_collocations_equal_plain_counts(spark, monkeypatch, range_size, partitions):
    monkeypatch.setattr(collocations, "BLOCK", 16)
    rows = awkward_rows() + sentences(3, 60)
    docs = table(spark, rows).repartition(partitions)
    found = collocations.collocations(docs, min_count=4, top=50, range_size=range_size)
    assert sorted(map(tuple, found.collect())) == brute_force(rows, 4, 50)


def test_inside_share(spark):
    rows = sentences(9, 40)
    found = collocations.collocations(table(spark, rows), min_count=3, top=10_000, inside=60)
    assert sorted(map(tuple, found.collect())) == brute_force(rows, 3, 10_000, inside=60)


def test_pieces_of_long_texts(spark, monkeypatch):
    rows = [(1, "one two three. " * 3000 + "four five " * 2000, "en", "s", 0)]
    want = brute_force(rows, 100, 2000)
    monkeypatch.setattr(collocations, "PIECE", 1000)
    monkeypatch.setattr(collocations, "CACHED", 500)
    monkeypatch.setattr(collocations, "BUFFER", 500)
    assert sorted(map(tuple, collocations.collocations(table(spark, rows)).collect())) == want


def test_empty_and_clashing_columns(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(1, None, None, None, 0), (2, "", "en", None, 0)])).count() == 0
    rows = sentences(4, 30)
    plain = sorted(map(tuple, collocations.collocations(table(spark, rows), min_count=5).collect()))
    from pyspark.sql import functions as F

    clashing = table(spark, rows)
    for column in ("phrase", "n", "word", "words", "key", "rank", "range", "body", "salt"):
        clashing = clashing.withColumn(column, F.lit("x"))
    assert plain and sorted(map(tuple, collocations.collocations(clashing, min_count=5).collect())) == plain
