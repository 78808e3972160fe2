"""Substring dedup with fixed-block anchors.

Every document is a reference for the ones with larger ids. Its words are cut into non-overlapping blocks of ``(window + 1) / 2`` words, the anchors;
every window of words of the full length holds a whole anchor of the document it comes from. All rolling windows of block length probe
the anchors. Around the hits, windows of full length are compared by 128-bit hashes with the smallest document id that holds them, which
extends hits to maximal exact repeats: a repeat is a run of such windows, and its words go where an earlier document has them.

Both steps ask a distributed index in pages (see ``pages``), so a passage in many documents costs each page one hash.

Null and empty texts have no words. Rows with a null id neither lose words nor make others lose them. Rows of one id do
not remove each other's words. Words inside a repeat of one document alone stay. Extra columns are not read. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logweir.llm.common import Rolling, WordHashes, covered, from_rows, mix
from logweir.llm import pages as P
from logweir.session import materialise

WINDOW = 13
SPARE_BITS = 14   # chance of a false anchor hit: 2 ** -SPARE_BITS
_SECOND = np.uint64(0xD6E8FEB86659FD93)


class Page:
    """Windows of one page: block-length hashes, anchors, and full-length hashes of chosen windows."""

    def __init__(self, hashes: WordHashes, ids: list, texts: list[bytes | None], window: int, block: int):
        hashes.trim()
        self.ids, self.window, self.block = ids, window, block
        self.words = [t.split() if t else [] for t in texts]
        self.rolling: dict[int, Rolling] = {}
        short, anchor, self.begin = [], [], [0]
        for k, words in enumerate(self.words):
            n = max(0, len(words) - block + 1)
            if ids[k] is None or len(words) < window:
                n = 0
            else:
                self.rolling[k] = Rolling(hashes.of(words))
                short.append(self.rolling[k].windows(block))
                marks = np.zeros(n, bool)
                marks[::block] = True
                anchor.append(marks)
            self.begin.append(self.begin[-1] + n)
        self.short = np.concatenate(short) if short else np.empty(0, np.uint64)
        self.anchor = np.concatenate(anchor) if anchor else np.empty(0, bool)

    def probes(self, bits: int):
        """Sorted distinct short hashes, which of them are anchors or occur twice, and the place of every window."""
        cut = self.short >> np.uint64(64 - bits)
        values, place, counts = np.unique(cut, return_inverse=True, return_counts=True)
        anchors = np.zeros(len(values), bool)
        anchors[place[self.anchor]] = True
        return values, anchors, counts > 1, place

    def chosen(self, hit: np.ndarray):
        """Document and start of the full windows that hold a hit, with two hashes of each."""
        docs, starts, one, two = [], [], [], []
        for k, rolling in self.rolling.items():
            mark = hit[self.begin[k] : self.begin[k + 1]]
            if not mark.any():
                continue
            n = rolling.n - self.window + 1
            sums = np.concatenate(([0], np.cumsum(mark)))
            span = self.window - self.block + 1
            at = np.flatnonzero(sums[span : span + n] > sums[:n])
            if not len(at):
                continue
            docs.append(np.full(len(at), k))
            starts.append(at)
            one.append(rolling.windows(self.window)[at])
            two.append(self._second(k)[at])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return join(docs, np.int64), join(starts, np.int64), join(one, np.uint64), join(two, np.uint64)

    def _second(self, k: int) -> np.ndarray:
        """An independent hash of the full windows: the words' hashes are mixed anew."""
        prefix = self.rolling[k]
        words = np.diff(prefix.prefix) * prefix.back[: prefix.n]
        return Rolling(mix(words ^ _SECOND)).windows(self.window)

    def windows(self, hit: np.ndarray):
        """Sorted distinct full windows (two hashes) with their smallest id, and the windows' places in them."""
        docs, starts, one, two = self.chosen(hit)
        own = np.array([-1 if i is None else i for i in self.ids], np.int64)[docs]
        order = np.lexsort((own, two, one))
        a, b = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return docs, starts, a[new], b[new], own[order][new], own, place


def _page(row: dict, hashes: WordHashes, window: int, block: int) -> Page:
    return Page(hashes, row["ids"], P.read_page(row["lengths"], row["body"]), window, block)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _anchor_reply(requests: list[tuple]) -> list[np.ndarray]:
    """An anchor that occurs twice anywhere is a hit."""
    lists = [P.unpack_sorted(h) for h, _ in requests]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=2 * len(v)).reshape(2, -1) for v, (_, f) in zip(lists, requests)]
    values = np.concatenate(lists)
    distinct, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    bits = np.concatenate(flags, 1).astype(bool)
    anchor, twice = np.zeros(len(distinct), bool), counts > 1
    anchor[place[bits[0]]] = True
    twice[place[bits[1]]] = True
    return np.split((anchor & twice)[place], np.cumsum([len(v) for v in lists])[:-1])


def _earliest_reply(requests: list[tuple]) -> list[np.ndarray]:
    """Whether another page has the window in a document with a smaller id."""
    lists = [P.unpack_sorted(h) for h, _, _ in requests]
    one = np.concatenate(lists)
    two = np.concatenate([P.unpack_planes(s) for _, s, _ in requests])
    ids = np.concatenate([P.unpack_planes(i).view(np.int64) for _, _, i in requests])
    order = np.lexsort((ids, two, one))
    a, b = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.empty(len(order), np.int64)
    least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return np.split(least < ids, np.cumsum([len(v) for v in lists])[:-1])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    page_bytes: int = P.PAGE_BYTES, keep_text: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``keep_text`` also the kept words."""
    block = (window + 1) // 2
    pages = P.write_pages(docs, id_col, text_col, page_bytes)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(0)))
    windows = max(1, (pages.agg(F.sum(size)).first()[0] or 0) // 4)
    bits = min(64, int(windows).bit_length() + SPARE_BITS)
    parts = P.part_count(windows)
    sizes_of = lambda values, width: np.diff(P.bounds(values, width, parts))
    ask = T.StructType.fromDDL(P.ASK)
    ask_arrow = to_arrow_schema(ask)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for row in _rows(batches):
            values, anchors, twice, _ = _page(row, hashes, window, block).probes(bits)
            edge = P.bounds(values, bits, parts).tolist()
            out = [
                (p, row["page"], P.pack_sorted(values[x:y]), [np.packbits(np.stack([anchors[x:y], twice[x:y]])).tobytes()])
                for p, (x, y) in enumerate(zip(edge, edge[1:])) if y > x
            ]
            if out:
                yield from_rows(out, ask_arrow)

    anchors = materialise(P.answer(pages.mapInArrow(ask_anchors, ask), 0, parts, _anchor_reply), "anchors")

    def hits(page: Page, row: dict) -> np.ndarray:
        values, _, _, place = page.probes(bits)
        return P.joined_bits(row["answers"], 0, sizes_of(values, bits))[place]

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for row in _rows(batches):
            page = _page(row, hashes, window, block)
            _, _, one, two, least, _, _ = page.windows(hits(page, row))
            edge = P.bounds(one, 64, parts).tolist()
            out = [
                (p, row["page"], P.pack_sorted(one[x:y]), [P.pack_planes(two[x:y]), P.pack_planes(least[x:y].view(np.uint64))])
                for p, (x, y) in enumerate(zip(edge, edge[1:])) if y > x
            ]
            if out:
                yield from_rows(out, ask_arrow)

    asked = P.with_answers(pages, anchors).mapInArrow(ask_windows, ask)
    earlier = materialise(P.answer(asked, 1, parts, _earliest_reply), "earlier")

    fields = T.StructType.fromDDL(
        "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text
    )
    arrow = to_arrow_schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for row in _rows(batches):
            page = _page(row, hashes, window, block)
            docs_at, starts, one, _, least, own, place = page.windows(hits(page, row))
            seen = P.joined_bits(row["answers"], 1, sizes_of(one, 64))
            gone = seen[place] | (least[place] < own)
            docs_at, starts = docs_at[gone], starts[gone]
            edge = np.searchsorted(docs_at, np.arange(len(page.words) + 1))
            out = []
            for k, words in enumerate(page.words):
                mask = covered(starts[edge[k] : edge[k + 1]], window, len(words))
                removed = int(mask.sum())
                if removed:
                    words_kept = [w for w, m in zip(words, mask.tolist()) if not m]
                else:
                    words_kept = words
                body = b" ".join(words_kept)
                digest = hashlib.sha256(body).hexdigest()
                out.append((page.ids[k], len(words), removed, digest, *([body.decode()] if keep_text else [])))
            yield from_rows(out, arrow)

    return P.with_answers(pages, anchors.union(earlier)).mapInArrow(cut, fields)
