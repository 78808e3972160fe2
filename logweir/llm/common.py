"""Words, rolling hashes and table access shared by the operators of this folder."""

from __future__ import annotations

import gc
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

WORD = re.compile("[^\x20\x09-\x0D]+")
HASHED_WORDS = 1 << 16   # words that a cache of a task holds at most
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_powers: list[np.ndarray] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; exactly the six ASCII white-space characters separate them."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As ``words`` after lower-casing A-Z only."""
    return text.encode().lower().split() if text else []


def trim_cache(cache: dict, most: int) -> None:
    """Forget the later half of a cache above ``most`` entries: frequent words are met, and kept, first."""
    if len(cache) > most:
        for key in list(itertools.islice(cache, most // 2, None)):
            del cache[key]


class WordHashes(dict):
    """64-bit hashes of words as eight bytes; ``trim`` keeps the memory bounded."""

    def __missing__(self, word: bytes | str) -> bytes:
        value = self[word] = xxhash.xxh64_digest(word)
        return value

    def trim(self) -> None:
        trim_cache(self, HASHED_WORDS)

    def of(self, words: list) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(4096, 1 << n.bit_length())
        tables = []
        for base in (_FACTOR, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers


class Rolling:
    """Polynomial hashes of all windows of any length from one array of prefix sums."""

    def __init__(self, hashes: np.ndarray):
        forward, self.back = _power_tables(len(hashes) + 1)
        self.n = len(hashes)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * forward[: self.n], out=self.prefix[1:])

    def windows(self, width: int) -> np.ndarray:
        count = self.n - width + 1
        if count <= 0:
            return np.empty(0, np.uint64)
        return mix((self.prefix[width:] - self.prefix[:count]) * self.back[:count])


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def map_rows(
    df: DataFrame,
    fields: T.StructType,
    row: Callable[..., tuple],
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """One output row per input row, computed by ``row(state, *columns)`` over Arrow batches.

    ``setup`` makes the state of a task (caches, automata) once.
    """
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for part in slices(batch):
                out = [row(state, *values) for values in zip(*(c.to_pylist() for c in part.columns))]
                yield from_rows(out, arrow)
        del state
        release_memory()

    return df.mapInArrow(run, fields)


def release_memory() -> None:
    """Give memory that a task no longer needs back to the system; its worker process lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def typed(ddl: str, **kinds: T.DataType) -> T.StructType:
    """The fields of ``ddl``, some of them with the type of a given column."""
    return T.StructType([
        T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in T.StructType.fromDDL(ddl)
    ])


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterable[pa.RecordBatch]:
    """A batch in short pieces, so that few texts are Python objects at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def from_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
    )


def repeat_get(mapping: dict, default: bytes, keys: list) -> bytes:
    """The joined values of keys, without a Python call per key."""
    return b"".join(map(mapping.get, keys, itertools.repeat(default)))
