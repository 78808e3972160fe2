"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items are inserted into one suffix automaton. Document words are streamed
through it; where the longest match reaches the length of an item window, the words of the window are hit.
Words are streamed only in stretches whose neighbouring pairs all occur in items (a numpy lookup): a longer match cannot
leave such a stretch, so nothing is lost.

The automaton is built from blocks of about ``BLOCK_WORDS`` item words; every block is one narrow pass over the
documents, without a shuffle, written before the next one starts. Only a block is ever on the driver, or in a task.

Null and empty texts have no words and are never hit; null and empty items have no windows. Repeated items and ids are counted
by distinct item id, a null item id is left out. Repeated documents are judged row by row. Extra columns are kept by
``decontaminate`` and not read otherwise. Empty tables give empty or unhit results.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logweir.llm.common import covered, map_rows, release_memory, repeat_get, slices, typed
from logweir.session import materialise

WINDOW = 10
BLOCK_WORDS = 100_000
_PAIR_BITS = 22
_SEPARATORS = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOUND = "array<struct<start:int,width:int>>"


def item_words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.encode().lower().translate(_SEPARATORS).split() if text else []


def _pair_slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _PAIR_BITS)


class Automaton:
    """Suffix automaton of many word sequences, with the windows that count as hits."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, bytes] = {}
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        self.names = [name for name, _ in items]
        numbers: dict[bytes, int] = {}
        coded = []
        for _, item in items:
            code = [numbers.setdefault(word, len(numbers) + 1) for word in item]
            coded.append(code)
            self._insert(code)
            if len(code) > 1:
                a = np.array(code, np.uint32)
                self.pairs[_pair_slot(a[:-1], a[1:])] = True
        self.vocabulary = {w: np.uint32(k).tobytes() for w, k in numbers.items()}
        self.targets: dict[tuple[int, int], set[int]] = {}
        for k, code in enumerate(coded):
            width = min(window, len(code))
            for at in range(len(code) - width + 1 if width else 0):
                state = 0
                for word in code[at : at + width]:
                    state = self.next[state][word]
                self.targets.setdefault((state, width), set()).add(k)
        self.widths = sorted({width for _, width in self.targets})
        self.ends = {width: self._ends(width) for width in self.widths}

    def _ends(self, width: int) -> array:
        """Per state, the state of its last ``width`` words: the suffix link is followed once per state."""
        up = array("i", bytes(4 * len(self.length)))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            link = self.link[state]
            up[state] = up[link] if self.length[link] >= width else state
        return up

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state that holds exactly ``parent`` extended by ``word``."""
        old = self.next[parent][word]
        if self.length[old] == self.length[parent] + 1:
            return old
        copy = self._state(self.length[parent] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = copy
        while parent >= 0 and self.next[parent].get(word) == old:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _insert(self, code: list[int]) -> None:
        last = 0
        for word in code:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, word)
            last = new

    def stretches(self, code: np.ndarray) -> list[tuple[int, int]]:
        """Where a match of the shortest window is possible."""
        if not self.widths or len(code) < self.widths[0]:
            return []
        least = self.widths[0]
        if least == 1:
            good, more = code > 0, 0
        else:
            good = self.pairs[_pair_slot(code[:-1], code[1:])] & (code[:-1] > 0) & (code[1:] > 0)
            more, least = 1, least - 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= least
        return list(zip(begin[long].tolist(), (end[long] + more).tolist()))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(start, width) of every window found, and the numbers of the items."""
        code = np.frombuffer(repeat_get(self.vocabulary, b"\0\0\0\0", words), np.uint32)
        found, items = [], set()
        for begin, end in self.stretches(code):
            state = matched = 0
            for at, word in enumerate(code[begin:end].tolist(), begin):
                while state and word not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if word in self.next[state]:
                    state, matched = self.next[state][word], matched + 1
                for width in self.widths:
                    if width > matched:
                        break
                    holders = self.targets.get((self.ends[width][state], width))
                    if holders:
                        found.append((at - width + 1, width))
                        items |= holders
        return found, items


def _block_count(items: DataFrame, item_text: str, block_words: int) -> int:
    total = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    return max(1, -(-total // (6 * block_words)))


def _block(items: DataFrame, item_id: str, item_text: str, k: int, count: int):
    """(id, words) of the items of block ``k``; about six characters make a word."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("body"))
    part = rows.filter("item is not null and body is not null").filter(
        F.expr(f"pmod(xxhash64(item, body), {count}) = {k}")
    )
    return [(r.item, item_words(r.body)) for r in part.toLocalIterator()]


def item_hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep_text: bool = True,
) -> DataFrame:
    """doc_id, text, n_words, found windows (start and width in words), ids of the items found.

    Without ``keep_text`` the texts end with the last pass and the column is null.
    """
    fields = typed(
        f"doc_id long, text string, n_words long, found {FOUND}, items array<string>",
        doc_id=docs.schema[id_col].dataType,
    )
    out = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast(FOUND).alias("found"), F.lit(None).cast("array<string>").alias("items"),
    )
    count = _block_count(items, item_text, block_words)
    for k in range(count):
        block = _block(items, item_id, item_text, k, count)
        automaton = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))
        keep = keep_text or k + 1 < count
        if k:
            out = materialise(out, "item-block")   # one automaton in a task at a time

        def row(shared, doc_id, text, _, found, held, keep=keep):
            words = item_words(text)
            new, numbers = shared.value.hits(words)
            return (
                doc_id, text if keep else None, len(words),
                (found or []) + [{"start": s, "width": w} for s, w in new],
                sorted({*(held or []), *(shared.value.names[n] for n in numbers)}),
            )

        out = map_rows(out, fields, row, lambda shared=automaton: shared)
    return out


def _hit_words(n: int, found) -> np.ndarray:
    mask = np.zeros(n, bool)
    for width in {f["width"] for f in found or []}:
        mask |= covered(np.array([f["start"] for f in found if f["width"] == width]), width, n)
    return mask


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: words, hit words, items found and their digest, contaminated."""
    fields = typed(
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
        "contaminated boolean",
        doc_id=docs.schema[options.get("id_col", "doc_id")].dataType,
    )

    def row(_, doc_id, n, found, held):
        hit = int(_hit_words(n, found).sum())
        digest = hashlib.sha256(",".join(held).encode()).hexdigest()
        return doc_id, n, hit, len(held), digest, hit > 0

    hits = item_hits(docs, items, keep_text=False, **options).drop("text")
    return map_rows(hits, fields, row)


def cut_spans(text: str, mask: np.ndarray, min_span: int) -> str:
    """The text without spans of at least ``min_span`` hit words (separators after a span stay)."""
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw.lower())]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    out, at = [], 0
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if end - begin >= min_span:
            out.append(raw[at : spans[begin][0]])
            at = spans[end - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    min_span: int = 1,
    max_coverage: float = 0.8,
    **options,
) -> DataFrame:
    """Documents without the spans that items cover; mostly covered documents are dropped.

    A span is removed if it has at least ``min_span`` words, a document if more than ``max_coverage`` of its words
    are hit. All columns of ``docs`` are returned.
    """
    item_id, item_text = options.get("item_id", "item_id"), options.get("item_text", "text")
    count = _block_count(items, item_text, options.get("block_words", BLOCK_WORDS))
    at, held = docs.columns.index(text_col), len(docs.columns)
    hits = "_hits"
    while hits in docs.columns:
        hits += "_"
    out = docs if count == 1 else docs.withColumn(hits, F.lit(None).cast("binary"))
    for k in range(count):
        automaton = docs.sparkSession.sparkContext.broadcast(
            Automaton(_block(items, item_id, item_text, k, count), options.get("window", WINDOW))
        )

        def run(batches, shared=automaton, last=k + 1 == count):
            """Hit words of earlier blocks are a bit mask in the last column; the last block cuts the texts."""
            for batch in batches:
                for part in slices(batch):
                    masks = part.column(held).to_pylist() if count > 1 else [None] * part.num_rows
                    texts = part.column(at).to_pylist()
                    found = [_hit_mask(shared.value, text, mask) for text, mask in zip(texts, masks)]
                    if not last:
                        column = pa.array([None if m is None else np.packbits(m).tobytes() for m in found], pa.binary())
                        yield part.set_column(held, part.schema.field(held), column)
                        continue
                    if any(m is not None for m in found):
                        cut = [t if m is None else cut_spans(t, m, min_span) for t, m in zip(texts, found)]
                        part = part.set_column(at, part.schema.field(at), pa.array(cut, part.schema.field(at).type))
                    stay = [m is None or bool(m.mean() <= max_coverage) for m in found]
                    yield part.filter(pa.array(stay, pa.bool_()))
            release_memory()

        if k:
            out = materialise(out, "item-block")
        out = out.mapInArrow(run, out.schema)
    return out.select(*docs.columns)


def _hit_mask(automaton: Automaton, text: str | None, packed: bytes | None) -> np.ndarray | None:
    """Which words of a text are hit, by this automaton or by earlier ones (``packed``); None if none is."""
    words = item_words(text)
    new, _ = automaton.hits(words)
    if not new and packed is None:
        return None
    mask = _hit_words(len(words), [{"start": s, "width": w} for s, w in new])
    if packed is not None:
        mask |= np.unpackbits(np.frombuffer(packed, np.uint8), count=len(words)).astype(bool)
    return mask
