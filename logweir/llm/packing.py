"""Bounded-space online packing of token sequences.

Every task keeps a fixed number of open windows. A piece goes to the open window that it fills best; when none has room,
the fullest window is emitted and a new one is opened. What is still open at the end of the tasks is
merged: open windows are packed as items into new windows, in groups of bounded size. Only lengths
move between tasks, never tokens.

Token ids come word by word from the public tokenizer (its rules never join across white space; U+001C to U+001F
are none for it, and get ids), so repeated words are encoded once per cache. A document is its ids and one end id; documents above a window are
cut into full windows and a rest.

Null and empty texts are the end id alone. Rows with equal or null doc_id are packed each for itself. Extra
columns are not read. An empty table gives no pieces. Windows are padded to their size except at a power of two.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logweir.llm.common import from_rows, release_memory, slices, trim_cache
from logweir.session import materialise

WINDOW = 4096
OPEN_WINDOWS = 64
MERGE_GROUP = 4096       # open windows that are merged by one task
CACHED_WORDS = 1 << 19
ENCODED_AT_ONCE = 2048
END_ID = 2
TOKENIZER = "word_bpe_49k.json"

SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space for str.split, but not for the tokenizer
_SPACE = re.compile(rf"[^\S{SEPARATORS}]+")

# Words of these letters, perhaps with such signs behind them, go to the tokenizer's model without its text passes.
LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and c not in "\xaa\xb5\xba")
SIGNS = "".join(c for c in map(chr, range(0x21, 0x7f)) if not c.isalnum() and c != "'")
_PLAIN = re.compile(f"([{LETTERS}]+)([{re.escape(SIGNS)}]*)")

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECE + ", sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def split_words(text: str) -> list[str]:
    """Words between what the tokenizer takes as white space."""
    if any(c in text for c in SEPARATORS):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def plain_signs(tokenizer) -> dict[int, str] | None:
    """What the model sees of each of LETTERS and SIGNS; None where it sees more or less than these in a row.

    A word of letters has to be one unit for the model, signs behind it another, whatever their case and order, and no added token may lie in both.
    """
    if tokenizer.pre_tokenizer is None:
        return None
    normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str

    def units(text):
        return [unit for unit, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal(text))]

    table = {ord(c): "".join(units(c)) for c in LETTERS + SIGNS}
    turns = (LETTERS, LETTERS[::-1], LETTERS[::7] + LETTERS[::5])
    tried = [[t, s] for t in turns for s in (SIGNS, SIGNS[::-1])] + [[t] for t in turns] + [["x", c] for c in SIGNS]
    same = all(units("".join(parts)) == [part.translate(table) for part in parts] for parts in tried)
    added = any(
        re.fullmatch(f"[{LETTERS}]*[{re.escape(SIGNS)}]*", t.content) for t in tokenizer.get_added_tokens_decoder().values()
    )
    return table if same and not added else None


class WordIds(dict):
    """Ids of a word as little-endian unsigned 32-bit numbers; unseen words are encoded in batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model, self.seen_as = tokenizer.encode_batch_fast, tokenizer.model, plain_signs(tokenizer)
        self.units: dict[str, bytes] = {}   # of letters or signs, as the model sees them

    def unit(self, text: str) -> bytes:
        """Ids of what is one unit for the model."""
        ids = self.units.get(text)
        if ids is None:
            found = [t.id for t in self.model.tokenize(text)]
            ids = self.units[text] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def learn(self, words: set[str]) -> None:
        """Encode unseen words; the tokenizer splits a full stop or comma from the letter before it."""
        if self.seen_as:
            others = set()
            for word in words:
                if plain := _PLAIN.fullmatch(word):
                    letters, signs = plain.groups()
                    ids = self.unit(letters.translate(self.seen_as))
                    self[word] = ids + self.unit(signs.translate(self.seen_as)) if signs else ids
                else:
                    others.add(word)
            words = others
        ended = [w for w in words if w[-1] in ",." and w[-2:-1].lower().isalpha()]
        plain = words.difference(ended)
        if ended:
            plain.update(",.", (w[:-1] for w in ended))
        todo = [w for w in plain if w not in self]
        for at in range(0, len(todo), ENCODED_AT_ONCE):   # an encoding holds much more than the ids
            some = todo[at : at + ENCODED_AT_ONCE]
            for word, encoded in zip(some, self.encode(some, add_special_tokens=False)):
                ids = encoded.ids
                self[word] = struct.pack(f"<{len(ids)}I", *ids)
        self.update((w, self[w[:-1]] + self[w[-1]]) for w in ended)

    def of(self, texts: list[str | None]) -> list[bytes]:
        trim_cache(self, CACHED_WORDS)
        trim_cache(self.units, CACHED_WORDS)
        lists = [split_words(t) if t else [] for t in texts]
        coded = [list(map(self.get, words)) for words in lists]
        self.learn({w for words, ids in zip(lists, coded) for w, i in zip(words, ids) if i is None})
        return [
            b"".join([self[w] if i is None else i for w, i in zip(words, ids)])
            for words, ids in zip(lists, coded)
        ]


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One cache of words per worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


class OpenWindows:
    """Best-fit over a fixed number of open windows; ``emit`` gets the items of a closed one."""

    def __init__(self, size: int, count: int, emit: Callable[[list], None]):
        self.size, self.emit = size, emit
        self.room = np.full(count, size, np.int64)
        self.items: list[list] = [[] for _ in range(count)]

    def place(self, item, length: int) -> None:
        left = self.room - length
        slot = int(np.argmin(np.where(left >= 0, left, self.size + 1)))
        if left[slot] < 0:
            slot = int(np.argmin(self.room))
            self.close(slot)
        self.items[slot].append(item)
        self.room[slot] -= length
        if self.room[slot] == 0:
            self.close(slot)

    def close(self, slot: int) -> None:
        if self.items[slot]:
            self.emit(self.items[slot])
        self.items[slot], self.room[slot] = [], self.size

    def rest(self) -> list[list]:
        return [items for items in self.items if items]


def pieces(doc_id, data: bytes, window: int) -> Iterator[tuple]:
    """(doc_id, start, length, crc32, doc_tokens) of full windows and the rest."""
    total = len(data) // 4
    for start in range(0, total, window):
        part = data[4 * start : 4 * (start + window)]
        yield doc_id, start, len(part) // 4, zlib.crc32(part), total


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    merge_group: int = MERGE_GROUP,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()
    fields = T.StructType.fromDDL(PLACED + ", open boolean")
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path)
        task = TaskContext.get().partitionId()
        rows: list[tuple] = []
        number = 0

        def emit(items: list[tuple], still_open: bool = False) -> None:
            nonlocal number
            sequence, at = (task << 32) | number, 0
            for piece in items:
                rows.append((*piece, sequence, at, still_open))
                at += piece[2]
            number += 1

        windows = OpenWindows(window, open_windows, emit)
        for batch in batches:
            for part in slices(batch, 128):
                coded = ids.of(part.column(1).to_pylist())
                for doc_id, data in zip(part.column(0).to_pylist(), coded):
                    for piece in pieces(doc_id, data + end, window):
                        windows.place(piece, piece[2])
                if rows:
                    yield from_rows(rows, arrow)
                    rows.clear()
        for items in windows.rest():
            emit(items, True)
        if rows:
            yield from_rows(rows, arrow)
        release_memory()

    placed = materialise(
        docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, fields), "pack"
    )
    done = placed.filter("not open").drop("open")
    return done.unionByName(_merge(placed.filter("open").drop("open"), window, open_windows, merge_group))


def _merge(left: DataFrame, window: int, open_windows: int, merge_group: int) -> DataFrame:
    """Pack the windows left open by the tasks into each other.

    A left window moves whole. Groups hold about ``merge_group`` windows; their number follows from a count.
    """
    counts = left.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    groups = max(1, -(-counts.count() // merge_group))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["sequence_id", "offset"], kind="stable")
        used = frame.groupby("sequence_id")["length"].sum().sort_values(ascending=False, kind="stable")
        moved: dict[int, tuple[int, int]] = {}

        def emit(items: list[tuple[int, int]]) -> None:
            at = 0
            for sequence, length in items:
                moved[sequence] = (items[0][0], at)
                at += length

        windows = OpenWindows(window, open_windows, emit)
        for sequence, length in used.items():
            windows.place((sequence, length), length)
        for items in windows.rest():
            emit(items)
        frame["offset"] += frame["sequence_id"].map(lambda s: moved[s][1])
        frame["sequence_id"] = frame["sequence_id"].map(lambda s: moved[s][0])
        return frame[out]

    out = [f.name for f in T.StructType.fromDDL(PLACED)]
    keyed = left.withColumn("_group", F.expr(f"pmod(xxhash64(sequence_id), {groups})"))
    return keyed.groupBy("_group").applyInPandas(lambda frame: merge(frame.drop(columns="_group")), PLACED)
