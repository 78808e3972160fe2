"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it is. Then small transducers rewrite a copy of the text - look-alike letters,
foreign and full-width digits, invisible characters, spelled digits, at/dot disguises - while every rewritten character
keeps the source span it came from. Identifiers of the rewritten text map back to source spans and
are added where they overlap no base span, or where they hold a shorter one of their kind. Only texts that hold a trace of a disguise are rewritten.

Null and empty texts have no spans. Texts are handled one by one, so repeated rows, ties and null ids change nothing; very long
texts cost linear time. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import unicodedata

from pyspark.sql import DataFrame

from logweir.llm.common import map_rows, typed

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base identifiers.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# Spelled digits and signs, in runs only.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s",
    "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J", "ο": "o", "α": "a", "ε": "e",
    "ι": "i", "ν": "v", "ρ": "p", "κ": "k", "τ": "t", "υ": "u", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Χ": "X", "Υ": "Y",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
HYPHENS = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63"
BLANKS = "\u00a0\u2002\u2003\u2009\u202f"

# Forms of the patterns that look at no character more than a few times, however long a run is.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_WHOLE_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")

_BRACKETED = re.compile(r"[\[({<]\s*+(?:(at|arroba|arobase|@)|dot|punto|point|punkt|\.)\s*+[\])}>]", re.I)
_ANCHOR = re.compile(r"(?<!\s)\s+at\s+|@", re.I)
_LEFT = re.compile(r"[A-Za-z0-9._%+-]++(?:\s++tod\s++[A-Za-z0-9._%+-]++)*+", re.I)   # of a reversed text
_RIGHT = re.compile(r"[A-Za-z0-9-]++(?:(?:\s++dot\s++|\.)[A-Za-z0-9-]++)++", re.I)
_PLAIN_PART = re.compile(r"\s+(at|dot)\s+", re.I)
_DIGIT_WORD = "(?:" + "|".join(SPELLED) + ")"
_RUN = re.compile(
    rf"(?<![^\W_])(?:plus[\s,-]+)?(?:{_DIGIT_WORD}|[0-9]+)(?:(?:[\s,.-]+|\s+(?:dot|point)\s+)"
    rf"(?:{_DIGIT_WORD}|[0-9]+))+(?![^\W_])", re.I
)
_RUN_PART = re.compile(rf"plus[\s,-]+|\s+(?:dot|point)\s+|{_DIGIT_WORD}|[0-9]+|[\s,.-]+", re.I)
# The gates: each finds something wherever its transducer would change the text.
_ELEMENT = rf"(?:{_DIGIT_WORD}|[0-9]+)(?![^\W_])"
_BETWEEN = r"(?:[\s,.-]+|\s+(?:dot|point)\s+)"
_SPELLED_NEAR = re.compile(rf"(?<![^\W_])(?:{_DIGIT_WORD}{_BETWEEN}{_ELEMENT}|[0-9]+{_BETWEEN}{_DIGIT_WORD}(?![^\W_]))", re.I)
_UNUSUAL = re.compile(
    "[" + INVISIBLE + HYPHENS + BLANKS
    + "\u0370-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\uff01-\uff5e]"
)
_PLAIN_WORD = re.compile(r"\s(?:dot\s|at\s+[A-Za-z0-9-]+(?:\s+dot\s|\.))", re.I)
_FINAL_LABEL = re.compile(r"\.[A-Za-z][A-Za-z0-9-]+$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _holds(kind: str, match: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") for p in match.split(".")]
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    digits = re.sub("[^0-9]", "", match)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def identifiers(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the leftmost non-overlapping matches of each kind that hold."""
    found = [(a, "email", b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        for kind in KINDS[1:]:
            pattern = _WHOLE_IP if kind == "ip" else PATTERNS[kind]
            if kind != "phone" or "+" in text:
                found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if _holds(kind, m.group())]
    return found


def _emails(text: str) -> list[tuple[int, int]]:
    """The matches of the email pattern, each found from its "@": to the left goes the run of local characters."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", max(at + 1, free))
    return found


class Mapped:
    """A rewritten text; character k comes from ``source[begin[k]:end[k]]``."""

    def __init__(self, source: str):
        self.text = source
        self.begin = range(len(source))
        self.end = range(1, len(source) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace sorted spans; a replacement's characters all come from the whole span."""
        if not edits:
            return
        text, begin, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            begin += [*self.begin[at:a], *[self.begin[a]] * len(new)]
            end += [*self.end[at:a], *[self.end[b - 1]] * len(new)]
            at = b
        text.append(self.text[at:])
        begin += self.begin[at:]
        end += self.end[at:]
        self.text, self.begin, self.end = "".join(text), begin, end


def _usual(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HYPHENS:
        return "-"
    if c in BLANKS:
        return " "
    if "\uff01" <= c <= "\uff5e":
        return chr(ord(c) - 0xFEE0)
    value = unicodedata.decimal(c, None)
    return str(value) if value is not None else LOOKALIKES.get(c, c)


def _characters(text: str) -> list[tuple[int, int, str]]:
    found = ((m.start(), m.end(), _usual(m.group())) for m in _UNUSUAL.finditer(text))
    return [e for e in found if e[2] != text[e[0] : e[1]]]


def _brackets(text: str) -> list[tuple[int, int, str]]:
    """Bracketed signs with the blanks around them."""
    edits, free = [], 0
    for m in _BRACKETED.finditer(text):
        a, b = m.span()
        while a > free and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        edits.append((a, b, "@" if m.group(1) else "."))
        free = b
    return edits


def _plain_addresses(text: str) -> list[tuple[int, int, str]]:
    """Signs spelled as words around an "at" or "@" with a name before it and a dotted one after it."""
    edits, free = [], 0
    for m in _ANCHOR.finditer(text):
        right = _RIGHT.match(text, m.end())
        left = right and m.start() >= free and _LEFT.match(text[free : m.start()][::-1])
        if left:
            start = m.start() - left.end()
            edits += [
                (start + p.start(), start + p.end(), "@" if p.group(1).lower() == "at" else ".")
                for p in _PLAIN_PART.finditer(text[start : right.end()])
            ]
            free = right.end()
        else:
            free = max(free, m.end())
    return edits


def _digit_runs(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _RUN.finditer(text):
        parts = list(_RUN_PART.finditer(m.group()))
        if sum(p.group().lower() in SPELLED for p in parts) < 2:
            continue
        for p in parts:
            part = p.group().lower()
            if part in SPELLED:
                new = SPELLED[part]
            elif part.startswith("plus"):
                new = "+"
            elif part.strip() in ("dot", "point"):
                new = "."
            else:
                new = part if part.isdigit() or part == "." else ""
            if new != p.group():
                edits.append((m.start() + p.start(), m.start() + p.end(), new))
    return edits


def disguised(text: str) -> list[tuple[int, str, int]]:
    """Source spans of identifiers that only the rewritten text shows."""
    unusual = not text.isascii() and _UNUSUAL.search(text)
    bracketed = any(c in text for c in "[({<") and _BRACKETED.search(text)
    if not (unusual or bracketed or _PLAIN_WORD.search(text) or _SPELLED_NEAR.search(text)):
        return []
    mapped = Mapped(text)
    for transducer in (_characters, _brackets, _plain_addresses, _digit_runs):
        mapped.rewrite(transducer(mapped.text))
    found = []
    for start, kind, end in identifiers(mapped.text):
        a, b = mapped.begin[start], mapped.end[end - 1]
        if text[a:b] != mapped.text[start:end] and (
            kind != "email" or _FINAL_LABEL.search(mapped.text[start:end])
        ):
            found.append((a, kind, b))
    return found


def _apart(spans: list[tuple[int, str, int]], base: list[tuple[int, str, int]]):
    """Spans that overlap nothing taken, except shorter base spans of their kind inside them."""
    held = sorted((a, b, kind) for a, kind, b in base)
    reach = list(itertools.accumulate((b for _, b, _ in held), max))   # the furthest end so far
    out, free = [], 0
    for a, kind, b in sorted(spans, key=_order):
        k = bisect.bisect_left(held, (b,))
        good = a >= free
        while good and k and reach[k - 1] > a:
            k -= 1
            x, y, other = held[k]
            good = y <= a or (a <= x and y <= b and (x, y) != (a, b) and other == kind)
        if good:
            out.append((a, kind, b))
            free = b
    return out


def _order(span: tuple[int, str, int]) -> tuple[int, int]:
    return span[0], KINDS.index(span[1])


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(spans, key=_order))


def find_spans(text: str | None) -> tuple[list, list]:
    """(base spans, added spans) as (start, kind, end)."""
    text = text or ""
    base = identifiers(text)
    return base, _apart(disguised(text), base)


def mask(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with ``<kind>`` in place of every span; overlapping spans count once."""
    out, at = [], 0
    for a, kind, b in sorted(spans, key=_order):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of base identifiers, and all spans with the disguised ones."""
    def row(_, doc_id, text):
        base, added = find_spans(text)
        counts = [sum(k == name for _, k, _ in base) for name in KINDS]
        digest = hashlib.sha256(_joined(base).encode()).hexdigest()
        return doc_id, *counts, digest, _joined(base + added)

    fields = typed(
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
        "spans string",
        doc_id=docs.schema[id_col].dataType,
    )
    return map_rows(docs.select(id_col, text_col), fields, row)


def masked_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all identifiers masked in the text column (null stays null)."""
    at = docs.columns.index(text_col)

    def row(_, *values):
        text = values[at]
        if not text:
            return values
        base, added = find_spans(text)
        return *values[:at], mask(text, base + added), *values[at + 1 :]

    return map_rows(docs, docs.schema, row)
