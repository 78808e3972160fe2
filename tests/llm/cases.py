"""Small tables with the awkward rows every operator must bear."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}x" for _ in range(n))


def edited(text: str, seed: int, changes: int) -> str:
    draw, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def awkward_rows() -> list[tuple]:
    """Nulls, empties, ties, repeated rows, a long text, near copies."""
    base = prose(1, 300)
    texts = [
        None, "", " \t\n ", "one", "one two", base, base, edited(base, 2, 3), edited(base, 3, 40),
        prose(4, 20_000), "é ß ñ\nç ü", "!!! ... ???", "repeat " * 50, prose(5, 60), prose(5, 60) + "\n" + prose(6, 60),
        " a b c", "x" * 10_000,
    ]
    rows = [(k * 3, t, "en" if k % 2 else None, f"s{k % 3}", 0) for k, t in enumerate(texts)]
    rows += [rows[5], (None, base, None, None, None), (None, None, None, None, None), (7, prose(8, 40), "fr", None, 1)]
    return rows


def table(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, DOCS)
