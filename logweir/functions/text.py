"""Column functions on log text. All of them are built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions.columns import once

# ---- fixed values -----------------------------------------------------------------
# the Unicode white space that a whitespace split recognises
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
BLOCK_ID = r"blk_[-]{0,1}[0-9]+"
SYMBOLS = r"[\*\.\?\+\$\^\[\]\(\)\{\}\|\\\/]"
TEMPLATE_DELIMITERS = r"[,\!:=\[\]\(\)\$\.\/\#\|\\" + WHITESPACE + "]"
OCTET = r"(\d|[1-9]\d|1\d{2}|2[0-4]\d|25[0-5])"
PORT = r"(6[0-5]{2}[0-3][0-5]|[1-5]\d{4}|[1-9]\d{1,3}|[0-9])"
# start or end of the text, or a neighbour that is no ASCII letter or digit
BEFORE = r"(?<![A-Za-z0-9])"
AFTER = r"(?![A-Za-z0-9])"
# ordered (pattern, mask) lists
MASKS = [
    (r"blk_(|-)[0-9]+", "[ID]"),
    (rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}:{PORT}", "[IPANDPORT]"),
    (BEFORE + r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})" + AFTER, "[IP]"),
    (BEFORE + r"([0-9a-f]{6,} ?){3,}" + AFTER, "[SEQ]"),
    (BEFORE + r"([0-9A-F]{4} ?){4,}" + AFTER, "[SEQ]"),
    (BEFORE + r"(0x[a-f0-9A-F]+)" + AFTER, "[HEX]"),
    (BEFORE + r"([\-\+]?\d+)" + AFTER, "[NUM]"),
    (r"(?<=executed cmd )(\".+?\")", "[CMD]"),
]
SPIRIT_MASKS = [
    (r"<.*>", "[ID]"),
    (
        r"((25[0-5]|2[0-4]\d|((1\d{2})|([1-9]?\d)))\.){3}"
        r"(25[0-5]|2[0-4]\d|((1\d{2})|([1-9]?\d)))",
        "[IP]",
    ),
    # word characters are Unicode letters and numbers here
    (r"\/([\p{L}\p{N}_\.]+\/?)*", "[PATH]"),
]
# ---- end of fixed values ----------------------------------------------------------

# Boundaries inside a camel-case word: separators, around every digit, lower to other,
# and before the last of a run of non-lower characters that a lower one follows.
_CAMEL_CUT = (
    r"[-_]+|(?<=[0-9])(?=.)|(?=[0-9])|(?<=\p{Ll})(?=[^\p{Ll}0-9_-])"
    r"|(?<=[^\p{Ll}0-9_-])(?=[^\p{Ll}0-9_-]\p{Ll})"
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: str | Column) -> Column:
    """Whitespace tokens; runs collapse, ends are trimmed."""
    return F.filter(F.split(_col(c), WHITESPACE + "+"), lambda t: t != "")


def drop_columns(c: str | Column, positions: Iterable[int], clean: bool = False) -> Column:
    """Remove token positions and join the rest by one space."""
    drop = [F.lit(p) for p in positions]
    kept = F.filter(tokens(c), lambda t, i: ~i.isin(drop)) if drop else tokens(c)
    text = F.array_join(kept, " ")
    return F.regexp_replace(text, SYMBOLS, "") if clean else text


def header(c: str | Column, position: int) -> Column:
    """One header token, NULL when the line is too short."""
    return F.get(tokens(c), F.lit(position))


def line_time(date: Column, time: Column) -> Column:
    """Timestamp of a `yyyy.MM.dd` and `HH:mm:ss` token pair, NULL when malformed."""
    well_formed = date.rlike(r"^\d{4}\.\d{2}\.\d{2}$") & time.rlike(r"^\d{2}:\d{2}:\d{2}$")
    return F.when(
        well_formed,
        F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyyy.MM.dd HH:mm:ss")),
    )


def is_alert(flag: str | Column, exact: bool = False) -> Column:
    """A line or flag token that does not start with `-` (``exact``: is not `-`)."""
    return _col(flag) != "-" if exact else ~_col(flag).startswith("-")


def mask(c: str | Column, rules: Sequence[tuple[str, str]] = MASKS) -> Column:
    """Apply the ordered masking rules."""
    out = _col(c)
    for pattern, label in rules:
        out = F.regexp_replace(out, pattern, label)
    return out


def found_keys(message: str | Column, raw: str | Column, regex: str = BLOCK_ID) -> Column:
    """Distinct keys of the message, or of the raw line when the message names none."""
    in_message = F.array_distinct(F.regexp_extract_all(_col(message), F.lit(regex), F.lit(0)))
    in_raw = F.array_distinct(F.regexp_extract_all(_col(raw), F.lit(regex), F.lit(0)))
    return F.when(F.size(in_message) > 0, in_message).otherwise(in_raw)


def template_tokens(c: str | Column) -> Column:
    """Tokens of a template text: delimiters split, `_…`, `-…` and blank tokens go."""
    return F.filter(
        F.split(_col(c), TEMPLATE_DELIMITERS),
        lambda t: (t != "") & ~t.startswith("_") & ~t.startswith("-"),
    )


def camel_words(c: str | Column) -> Column:
    """Lower-case words of a camel-case token; every digit is a word of its own."""
    return F.filter(
        F.transform(F.split(_col(c), _CAMEL_CUT), F.lower), lambda w: F.trim(w) != ""
    )


def extract_keys(lines: DataFrame, message: str, raw: str, regex: str = BLOCK_ID) -> DataFrame:
    """One row per line and key, `key_ord` is the order of the key inside the line."""
    return lines.select(
        "log_id", F.posexplode_outer(found_keys(message, raw, regex)).alias("key_ord", "key")
    ).filter(F.col("key").isNotNull())


def unkeyed_lines(lines: DataFrame, message: str, raw: str, regex: str = BLOCK_ID) -> DataFrame:
    """Lines that name no key at all."""
    return lines.filter(~_col(message).rlike(regex) & ~_col(raw).rlike(regex))


def parse_header(
    lines: DataFrame,
    raw: str = "raw",
    *,
    flag: int = 0,
    date: int = 2,
    node: int = 3,
    time: int = 6,
    drop: Iterable[int] = range(9),
    strict_ts: bool = False,
) -> DataFrame:
    """Typed header columns and the message of alert-style log lines.

    With ``strict_ts`` rows without a valid timestamp go; their line ids stay used.
    """
    split = once(lines, "_t", tokens(raw))
    at = lambda i: F.get("_t", F.lit(i))
    gone = [F.lit(p) for p in drop]
    kept = F.filter("_t", lambda t, i: ~i.isin(gone)) if gone else F.col("_t")
    out = once(split, "ts", line_time(at(date), at(time)))
    if strict_ts:
        out = out.filter(F.col("ts").isNotNull())
    return out.select(
        *lines.columns,
        at(flag).alias("alert_flag"),
        at(node).alias("node"),
        "ts",
        F.array_join(kept, " ").alias("message"),
        is_alert(at(flag)).alias("is_alert"),
    )
