"""Quality rules: share of a text that lies in repeated n-grams and repeated lines.

Rolling hashes of several n-gram lengths mark every word inside an n-gram that occurs
twice or more in its text (first occurrence included); the characters of the marked words are measured
against the characters of all words. A text fails a rule above its share.

Null and empty texts have no words: all counts are 0 and the text fails the base rule. Texts are
measured one by one, so ties, repeated rows and ids that are null or not unique change nothing. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from logweir.llm.common import WORD, Rolling, WordHashes, covered, map_rows, typed

# Highest share in per cent of the characters of words in repeated n-grams, by n.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_LIMIT = 30        # repeated lines, per cent of the lines with a word
LINE_CHAR_LIMIT = 20   # characters in repeated lines, per cent
MIN_WORDS = 20
BASE_WINDOW = 8
BASE_LIMIT = 30
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, n_lines long, dup_line_chars long, "
    + ", ".join(f"dup_chars_{n} long" for n in NGRAM_LIMITS)
)


def chars_of_words(text: str) -> int:
    return len(text) - sum(map(text.count, SPACES))


def in_repeats(rolling: Rolling, width: int) -> np.ndarray | None:
    """Words inside windows that occur more than once; None if there are none."""
    hashes = rolling.windows(width)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return None
    return covered(np.flatnonzero(np.isin(hashes, twice)), width, rolling.n)


def measure(hashes: WordHashes, doc_id, text: str | None) -> tuple:
    text = text or ""
    found = WORD.findall(text)
    n = len(found)
    hashes.trim()
    rolling = Rolling(hashes.of(found))
    total = chars_of_words(text)

    seen: set[str] = set()
    lines = dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            if line in seen:
                dup_lines += 1
                dup_line_chars += chars_of_words(line)
            seen.add(line)

    lengths = None
    repeat_words, chars = 0, {}
    for width in sorted({BASE_WINDOW, *NGRAM_LIMITS}):
        mask = in_repeats(rolling, width)
        if mask is None:
            chars[width] = 0
            continue
        if lengths is None:
            lengths = np.fromiter(map(len, found), np.int64, n)
        chars[width] = int(lengths[mask].sum())
        if width == BASE_WINDOW:
            repeat_words = int(mask.sum())

    failed = n < MIN_WORDS or 100 * repeat_words > BASE_LIMIT * n
    kept = (
        not failed
        and 100 * dup_lines <= LINE_LIMIT * lines
        and 100 * dup_line_chars <= LINE_CHAR_LIMIT * total
        and all(100 * chars[width] <= most * total for width, most in NGRAM_LIMITS.items())
    )
    symbols = sum(map(text.count, SYMBOLS))
    return (
        doc_id, n, total, symbols, dup_lines, repeat_words, failed, kept, lines, dup_line_chars,
        *(chars[width] for width in NGRAM_LIMITS),
    )


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every text, one row per input row."""
    fields = typed(SCHEMA, doc_id=docs.schema[id_col].dataType)
    return map_rows(docs.select(id_col, text_col), fields, measure, WordHashes)
