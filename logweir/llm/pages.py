"""Pages of documents that ask a distributed index about their hashes.

A page is one row with many compressed texts. It sends every part of the index the sorted hashes that belong there, coded as
differences in byte planes, and gets one bit per hash back. So an index over all windows of a corpus moves a few bytes per window, and
answers find their page by its number; no row ever holds more than a page or a part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logweir.llm.common import from_rows, slices
from logweir.session import materialise

PAGE_BYTES = 4 << 20
PART_HASHES = 1 << 20    # hashes of a part, up to MANY_PARTS parts
MANY_PARTS = 4096
MOST_HASHES = 1 << 26    # hashes of a part beyond that

PAGE = "page long, ids array<long>, lengths array<int>, body binary"


def write_pages(docs: DataFrame, id_col: str, text_col: str, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """page, ids, UTF-8 lengths (-1 for null) and compressed texts; a longer text is a page of its own."""
    fields = T.StructType.fromDDL(PAGE)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        page = TaskContext.get().partitionId() << 32
        ids, lengths, texts, held = [], [], [], 0
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns)):
                    raw = text.encode() if text is not None else b""
                    ids.append(doc_id)
                    lengths.append(len(raw) if text is not None else -1)
                    texts.append(raw)
                    held += len(raw)
                    if held >= page_bytes or len(ids) >= 1 << 16:
                        yield from_rows([(page, ids, lengths, packer.compress(b"".join(texts)))], arrow)
                        page, ids, lengths, texts, held = page + 1, [], [], [], 0
        if ids:
            yield from_rows([(page, ids, lengths, packer.compress(b"".join(texts)))], arrow)

    pages = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, fields)
    return materialise(pages, "pages")


def read_page(lengths: list[int], body: bytes) -> list[bytes | None]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    out, at = [], 0
    for n in lengths:
        out.append(raw[at : at + n] if n >= 0 else None)
        at += max(n, 0)
    return out


def part_count(hashes: int) -> int:
    return max(1, min(-(-hashes // PART_HASHES), MANY_PARTS), -(-hashes // MOST_HASHES))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    used = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return pack_planes(steps, used)


def pack_planes(values: np.ndarray, used: int = 8) -> bytes:
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :used].T)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_planes(data: bytes) -> np.ndarray:
    used = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.reshape(-1).view("<u8")


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(data), dtype=np.uint64)


def bounds(values: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where the parts begin and end in sorted ``bits``-bit values."""
    edges = [min((k << bits) // parts + bool((k << bits) % parts), (1 << 64) - 1) for k in range(1, parts)]
    inner = np.searchsorted(values, np.array(edges, np.uint64))
    return np.concatenate(([0], inner, [len(values)])).astype(np.int64)


ASK = "part int, page long, hashes binary, more array<binary>"
ANSWER = "page long, question int, part int, bits binary"


def answer(
    asked: DataFrame, question: int, parts: int, reply: Callable[[list[tuple]], list[np.ndarray]]
) -> DataFrame:
    """The bits of every request; ``reply`` gets the requests (hashes, *more) of one part.

    Parts are ranges of mixed hashes, a page sends a hash once: no part is hot.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("page", kind="stable")
        bits = reply([(h, *m) for h, m in zip(frame["hashes"], frame["more"])])
        return pd.DataFrame({
            "page": frame["page"], "question": question, "part": frame["part"],
            "bits": [np.packbits(b).tobytes() for b in bits],
        })

    return asked.groupBy("part").applyInPandas(run, ANSWER)


def with_answers(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Every page with all its answers (at most one per question and part)."""
    each = answers.groupBy("page").agg(F.collect_list(F.struct("question", "part", "bits")).alias("answers"))
    return pages.join(each, "page", "left")


def joined_bits(answers: list[dict] | None, question: int, sizes: np.ndarray) -> np.ndarray:
    """The bits of a question in the order of the page's sorted hashes; ``sizes`` are those of the parts."""
    out = np.zeros(int(sizes.sum()), bool)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    for a in answers or []:
        if a["question"] == question:
            n = int(sizes[a["part"]])
            bits = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=n)
            out[begin[a["part"]] : begin[a["part"]] + n] = bits
    return out
