"""Fill-in-middle transformation: cut a text at two unit ends and move its middle to the end.

One fullmatch of ``(unit)*`` with the regex library keeps every repetition of the group: ``match.ends(1)`` is the end of each unit, its
length their number n, and the two cut offsets are read from it. A unit is a line with its newline, or what follows the last newline.
Lengths and offsets are code points. Both cuts come from a hash of the seed and the id, so a rerun gives the same rows in any order.

Null texts count as empty. Empty texts and texts that contain a mark stay plain, as does a share of the others that ``rate`` sets; n is
counted for plain texts, too. A null id is hashed as the empty string; repeated rows give equal rows. Texts are matched whole; the ends of one text
(an int per unit) are held at a time. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import regex
from pyspark.sql import Column, DataFrame, functions as F

from logweir.llm.common import map_rows, typed

UNITS = regex.compile(r"([^\n]*\n|[^\n]+)*")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50   # seed; texts in 100 that are transformed; those in 100 of them with the suffix first
FIELDS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, key: object) -> list[int]:
    """Four numbers below 2^32 that depend on seed and id only."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearrange(text: str, key: object, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple:
    """(n, form, prefix length, middle length, output) of one text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    one, two, chosen, order = draws(seed, key)
    if not n or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or chosen % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((one % (n + 1), two % (n + 1)))
    a = ends[first - 1] if first else 0
    b = ends[second - 1] if second else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the transformed text (output) of every document."""
    fields = typed(FIELDS, doc_id=docs.schema[id_col].dataType)
    return map_rows(
        docs.select(id_col, text_col), fields,
        lambda _, key, text: (key, *rearrange(text or "", key, seed, rate, spm)),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from output and form alone.

    The marks are found at their first occurrence: a text with a mark is never transformed, and no mark can begin inside
    another one.
    """
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
