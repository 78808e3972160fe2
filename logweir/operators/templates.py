"""Template assignment and mining."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from logweir.functions.columns import once

# ---- fixed values: templates of the block-store log, in match order ----------------
HDFS_TEMPLATES = [
    r"Adding an already existing block (.*)",
    r"(.*)Verification succeeded for (.*)",
    r"(.*) Served block (.*) to (.*)",
    r"(.*):Got exception while serving (.*) to (.*):(.*)",
    r"Receiving block (.*) src: (.*) dest: (.*)",
    r"Received block (.*) src: (.*) dest: (.*) of size ([-]?[0-9]+)",
    r"writeBlock (.*) received exception (.*)",
    r"PacketResponder ([-]?[0-9]+) for block (.*) Interrupted\.",
    r"Received block (.*) of size ([-]?[0-9]+) from (.*)",
    r"PacketResponder (.*) ([-]?[0-9]+) Exception (.*)",
    r"PacketResponder ([-]?[0-9]+) for block (.*) terminating",
    r"(.*):Exception writing block (.*) to mirror (.*)(.*)",
    r"Receiving empty packet for block (.*)",
    r"Exception in receiveBlock for block (.*) (.*)",
    r"Changing block file offset of block (.*) from ([-]?[0-9]+) to ([-]?[0-9]+) meta file offset to ([-]?[0-9]+)",
    r"(.*):Transmitted block (.*) to (.*)",
    r"(.*):Failed to transfer (.*) to (.*) got (.*)",
    r"(.*) Starting thread to transfer block (.*) to (.*)",
    r"Reopen Block (.*)",
    r"Unexpected error trying to delete block (.*)\. BlockInfo not found in volumeMap\.",
    r"Deleting block (.*) file (.*)",
    r"BLOCK\* NameSystem\.allocateBlock: (.*)\. (.*)",
    r"BLOCK\* NameSystem\.delete: (.*) is added to invalidSet of (.*)",
    r"BLOCK\* Removing block (.*) from neededReplications as it does not belong to any file\.",
    r"BLOCK\* ask (.*) to replicate (.*) to (.*)",
    r"BLOCK\* NameSystem\.addStoredBlock: blockMap updated: (.*) is added to (.*) size ([-]?[0-9]+)",
    r"BLOCK\* NameSystem\.addStoredBlock: Redundant addStoredBlock request received for (.*) on (.*) size ([-]?[0-9]+)",
    r"BLOCK\* NameSystem\.addStoredBlock: addStoredBlock request received for (.*) on (.*) size ([-]?[0-9]+) But it does not belong to any file\.",
    r"PendingReplicationMonitor timed out block (.*)",
]
# ---- end of fixed values ---------------------------------------------------------------


def hdfs_catalog() -> list[tuple[int, str]]:
    return list(enumerate(HDFS_TEMPLATES))


def read_catalog(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """An `id,template` file as a catalog; larger catalogs are data, not code."""
    from logweir.sources.tables import read_templates

    rows = read_templates(spark, path).orderBy("template_id").collect()
    return [(r["template_id"], r["template"]) for r in rows]


WILDCARD = "(.*)"
FEW = 64                     # templates that are tried one by one in generated code
CATALOG_BYTES = 1 << 26
TESTS_HELD = 8192            # tests of single templates that a task keeps
_META = re.compile(r"[.^$*+?{}\[\]|()]")


def _literal(piece: str) -> str | None:
    """The text a regex piece stands for, None when it is not plain text."""
    escaped = re.sub(r"\\([^A-Za-z0-9])", "", piece)
    if _META.search(escaped) or "\\" in escaped:
        return None
    return re.sub(r"\\([^A-Za-z0-9])", r"\1", piece)


def longest_literal(template: str) -> str:
    """The longest text every match must contain, '' when there is none."""
    parts = re.split(r"\(\.\*\)|\(\[-\]\?\[0-9\]\+\)", template)
    known = [p for p in map(_literal, parts) if p is not None]
    return max(known, key=len, default="")


def prefix_pattern(template: str) -> str:
    """A Java pattern that finds the same lines as a prefix match of the template.

    Between wildcards plain text is searched leftmost-first and never given back, which is
    exact for text pieces and takes linear time; other templates stay as they are.
    `(?d)` makes `.` stop at line feeds only.
    """
    pieces = template.split(WILDCARD)
    if all(_literal(p) is not None for p in pieces):
        return "(?d)^" + pieces[0] + "".join(f"(?>.*?{p})" for p in pieces[1:] if p)
    return f"(?d)^(?:{template})"


def template_id_of(c: Column, catalog: list[tuple[int, str]]) -> Column:
    """Id of the first matching template. One compiled pattern per template; a contains
    test on its longest literal comes first."""
    out = F
    for template_id, template in catalog:
        test = c.rlike(prefix_pattern(template))
        literal = longest_literal(template)
        if literal:
            test = F.contains(c, F.lit(literal)) & test
        out = out.when(test, F.lit(template_id))
    return out.otherwise(F.lit(None).cast("int"))


def python_pattern(template: str) -> str:
    """As ``prefix_pattern`` for a match at the start of a text; `.` stops at line feeds only there anyway."""
    return prefix_pattern(template).removeprefix("(?d)^")


def _in_turn(pieces: list[str], text: str) -> bool:
    """As the pattern of plain pieces between wildcards: each is searched leftmost-first, in the same line as the one before."""
    at = len(pieces[0])
    if not text.startswith(pieces[0]):
        return False
    for piece in pieces[1:]:
        if piece:
            found = text.find(piece, at)
            if found < 0 or text.find("\n", at, found) >= 0:
                return False
            at = found + len(piece)
    return True


def text_test(template: str) -> Callable[[str], object]:
    """Whether a text starts with a match of the template; plain pieces between wildcards need no pattern."""
    pieces = [_literal(p) for p in template.split(WILDCARD)]
    return re.compile(python_pattern(template)).match if None in pieces else partial(_in_turn, pieces)


def catalog_table(catalog: list[tuple[int, str]]) -> pa.Table:
    """Ids and templates without a Python object for each."""
    return pa.table({
        "template_id": pa.array([i for i, _ in catalog], pa.int64()), "template": pa.array([t for _, t in catalog], pa.string()),
    })


class CatalogMatcher:
    """First match over a large catalog: literals first, patterns only where their literal occurs.

    An Aho-Corasick automaton over the longest literals of all templates reads a text once and names the templates that can
    match; templates without a literal always can. Candidates are tried in catalog order. Beside the automaton and the text of the
    catalog, only the ``TESTS_HELD`` tests made last stay in memory.
    """

    def __init__(self, catalog: list[tuple[int, str]] | pa.Table):
        held = catalog if isinstance(catalog, pa.Table) else catalog_table(catalog)
        self.ids, self.texts = (held.column(c).combine_chunks() for c in ("template_id", "template"))
        self.tests: dict[int, Callable[[str], object]] = {}     # made when first needed
        self.always: list[int] = []
        self.more: dict[int, list[int]] = {}     # other places of the same literal, by the first
        self.automaton = None
        for k, template in enumerate(self.texts):
            literal = longest_literal(template.as_py())
            if not literal:
                self.always.append(k)
                continue
            if self.automaton is None:
                import ahocorasick

                self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            first = self.automaton.get(literal, None)
            if first is None:
                self.automaton.add_word(literal, k)
            else:
                self.more.setdefault(first, []).append(k)
        if self.automaton is not None:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Places in the catalog of the templates that can match, in order."""
        found = set(self.always)
        if self.automaton is not None:
            for _, place in self.automaton.iter(text):
                found.add(place)
                found.update(self.more.get(place, ()))
        return sorted(found)

    def match(self, text: str | None) -> int | None:
        if text is None:
            return None
        for k in self.candidates(text):
            test = self.tests.get(k)
            if test is None:
                if len(self.tests) >= TESTS_HELD:
                    self.tests.clear()
                test = self.tests[k] = text_test(self.texts[k].as_py())
            if test(text):
                return self.ids[k].as_py()
        return None


def match_catalog(
    lines: DataFrame, catalog: list[tuple[int, str]], message: str = "message", fallback_col: str | None = None
) -> DataFrame:
    """As ``match_templates``, by one automaton for all templates; the catalog goes to every task.

    Catalogs above ``CATALOG_BYTES`` are refused: they would not fit beside the data of a task.
    """
    size = sum(len(t) for _, t in catalog)
    if size > CATALOG_BYTES:
        raise ValueError(f"a catalog of {size} characters; at most {CATALOG_BYTES} go to a task")
    shared = lines.sparkSession.sparkContext.broadcast(catalog_table(catalog))
    schema = StructType([*lines.schema.fields, StructField("template_id", IntegerType())])
    places = [lines.columns.index(c) for c in (message, fallback_col) if c]

    def run(batches):
        matcher = CatalogMatcher(shared.value)
        for batch in batches:
            found = [matcher.match(text) for text in batch.column(places[0]).to_pylist()]
            if len(places) > 1 and None in found:
                raw = batch.column(places[1]).to_pylist()
                found = [matcher.match(t) if i is None else i for i, t in zip(found, raw)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], schema.fieldNames())

    return lines.mapInArrow(run, schema)


def match_templates(
    lines: DataFrame,
    catalog: list[tuple[int, str]],
    message: str = "message",
    fallback_col: str | None = None,
) -> DataFrame:
    """Adds `template_id`: first match over the ordered catalog, NULL when unmatched.

    ``fallback_col`` is tried for unmatched messages. Row by row, without a shuffle; the
    patterns run once per line even when the caller filters on the result. Catalogs of more than ``FEW`` templates go through
    ``match_catalog``, which gives the same ids.
    """
    if len(catalog) > FEW:
        return match_catalog(lines, catalog, message, fallback_col)
    found = template_id_of(F.col(message), catalog)
    if fallback_col:
        found = F.coalesce(found, template_id_of(F.col(fallback_col), catalog))
    return once(lines, "template_id", found)


def unmatched_lines(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("template_id").isNull()).drop("template_id")


def template_report(log_events: DataFrame, templates: DataFrame) -> DataFrame:
    """(template_id, n, template)."""
    sizes = log_events.groupBy("template_id").agg(F.count("*").alias("n"))
    return sizes.join(templates, "template_id")
