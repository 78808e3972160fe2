"""Line dedup with a log-template tree, in DataFrame operations only.

Lines go down a tree of fixed depth: token count, then the first three tokens (tokens with a digit or @ are ``<*>``). Inside a leaf,
templates part by the tokens that most lines share: of a line of n tokens the ceil(n / 2) whose token is held, at its place, by most lines of the
leaf (the earlier place of equal ones) are its template, all others are variable fields. The rule has no count that decides
between constant and variable: a template's own tokens are in all of its lines, a field's value only in some of them, at any size of the input
and beside any number of other templates of the leaf. A template that recurs is dropped, in all documents, where

* the lines have at least ``MIN_TOKENS`` tokens, and each token of the template lies in ``MIN_DOCS`` lines,
* at least ``MIN_DOCS`` different texts have such lines,
* and these have at least half as many classes as there are texts. The class is the smallest hash of a text's pieces between punctuation
  (of ``PIECE_CHARS`` characters and more; of the whole text where there is none), which near copies of one document mostly share
  even if it is a single line: lines of near copies are left to document dedup, boilerplate of unlike documents goes, unless it is
  more than half of their pieces. Exact copies are one text, however many there are.

Two narrow passes over the texts count leaves and cut out the lines of leaves that can hold a recurring template; only these are
shuffled. Results are broadcast behind a count of their bytes (``BROADCAST_BYTES``), larger ones joined by shuffles.

Null texts stay null, have no lines and drop none; empty lines are kept. Rows with one text are cut alike, whatever their ids. Other
columns are kept, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweir.session import materialise

MIN_DOCS = 5
MIN_TOKENS = 4
LEADING = 3
PIECE_CHARS = 20
BROADCAST_BYTES = 1 << 26

FIELD = "<*>"
VARIABLE = r"[^ \t\n\x0B\f\r]*[0-9@][^ \t\n\x0B\f\r]*"


def sized(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """A written table, marked for broadcast only if its rows take at most ``BROADCAST_BYTES``."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)).alias("n")).first()["n"]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def _lines(docs: DataFrame, text_col: str) -> DataFrame:
    """text hash, line number, masked tokens and leaf of the lines with enough tokens, with the class of the text."""
    text = F.col(text_col)
    masked = F.when(
        text.rlike("[0-9@]"), F.regexp_replace(text, VARIABLE, FIELD)
    ).otherwise(text)
    pieces = F.filter(F.split(text, "[.,;:!?\n]"), lambda x: F.length(x) >= PIECE_CHARS)
    smallest = F.coalesce(F.array_min(F.transform(pieces, F.md5)), F.md5(text))
    # What belongs to a document is computed below the generator, what belongs to a line inside it: each once.
    base = docs.select(
        F.xxhash64(text).alias("doc"),
        F.xxhash64(smallest).alias("class"),
        F.translate(masked, "\t\x0b\f\r", "    ").alias("masked"),
    )
    lines = F.transform(
        F.split("masked", "\n"),
        lambda x, i: F.struct(i.alias("line"), F.filter(F.split(x, " "), lambda t: t != "").alias("tokens")),
    )
    long_lines = F.filter(lines, lambda x: F.size(x["tokens"]) >= MIN_TOKENS)
    return base.select("doc", "class", F.inline(long_lines)).withColumn(
        "leaf", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEADING))
    )


def _message() -> Column:
    return F.md5(F.array_join("tokens", " "))


def recurring_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc (a hash of the text) and number of the lines whose template recurs."""
    lines = _lines(docs, text_col)
    leaves = materialise(
        lines.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS).select("leaf"),
        "leaves",
    )
    some = materialise(
        lines.join(sized(leaves, 48), "leaf", "left_semi").withColumn("message", _message()), "lines"
    )
    # Equal lines are one message; the tokens of a message are counted with its lines.
    messages = some.groupBy("leaf", "message").agg(
        F.count("*").alias("n"), F.first("tokens").alias("tokens")
    )
    places = messages.select(
        "leaf", "message", "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("place", "token")
    ).filter(F.col("token") != FIELD)
    frequent = places.groupBy("leaf", "place", "token").agg(F.sum("n").alias("lines")).filter(F.col("lines") >= MIN_DOCS)
    kept = F.slice(F.col("held"), F.lit(1), F.ceil(F.col("size") / 2).cast("int"))
    templates = materialise(
        places.drop("n").join(frequent, ["leaf", "place", "token"])
        .groupBy("leaf", "message", "size").agg(
            F.array_sort(F.collect_list(F.struct(
                (-F.col("lines")).alias("lines"), "place", F.xxhash64("place", "token").alias("token")
            ))).alias("held")
        )
        .filter(F.size("held") * 2 >= F.col("size"))
        # Lines with the same tokens have the same counts for them, and so the same order.
        .select("leaf", "message", F.xxhash64(F.transform(kept, lambda c: c["token"])).alias("template")),
        "templates",
    )
    held = some.select("doc", "class", "leaf", "message").join(templates, ["leaf", "message"])
    # Texts of a class are counted before classes meet, so a hot template is summed in parts.
    classes = (
        held.groupBy("leaf", "template", "class", "doc").agg(F.lit(1).alias("one"))
        .groupBy("leaf", "template", "class").agg(F.count("*").alias("docs"))
        .groupBy("leaf", "template").agg(F.sum("docs").alias("docs"), F.count("*").alias("classes"))
    )
    recurring = materialise(
        templates.join(
            classes.filter((F.col("docs") >= MIN_DOCS) & (F.col("classes") * 2 >= F.col("docs"))),
            ["leaf", "template"], "left_semi",
        ).select("leaf", "message"),
        "recurring",
    )
    return some.join(sized(recurring, 112), ["leaf", "message"], "left_semi").select("doc", "line")


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` without recurring lines; with ``counts`` also ``n_lines`` and ``n_dropped``."""
    cut = materialise(
        recurring_lines(docs, text_col).groupBy("doc").agg(F.collect_set("line").alias("cut")), "cut",
    ).select(F.col("doc").alias("__recurring_doc"), F.col("cut").alias("__recurring_cut"))
    text = F.col(text_col)
    joined = docs.join(
        sized(cut, 64 + 8 * F.size("__recurring_cut")), F.xxhash64(text) == F.col("__recurring_doc"), "left"
    )
    kept = F.filter(
        F.split(text, "\n"), lambda x, i: ~F.array_contains("__recurring_cut", i)
    )
    body = F.when(F.col("__recurring_cut").isNull(), text).otherwise(F.array_join(kept, "\n"))
    columns = [body.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if counts:
        columns += [
            F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
            F.when(F.col("__recurring_cut").isNull(), 0).otherwise(F.size("__recurring_cut")).cast("long").alias("n_dropped"),
        ]
    return joined.select(*columns)
