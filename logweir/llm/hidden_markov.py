"""Language-model scoring with a hidden Markov model.

A state emits a word class, the class emits the word. Frequent words (at most ``TOP_WORDS``) are classes of their own; the others share
``SUFFIX_CLASSES`` classes by their ending, where a word has its smoothed share of the class. Exact word counts come from all
training documents; Baum-Welch counts are summed over all partitions, too: first in one pass over all training documents in ``START_STEPS`` parts,
after each of which the model moves on (stepwise Baum-Welch), then in ``ROUNDS`` rounds over all of them. A score is the exact log10 likelihood by the scaled forward recursion: the classes'
likelihood plus the words' shares.

The word counts stay a distributed table that grows with the corpus; what is collected is bounded by the number of classes.

Null and empty texts are the end token alone. Rows with a null id are not held out. Repeated rows are scored row by row and
learned from as often as they occur. Words are told apart by 64-bit hashes. Without training documents every token has base
probability 1 and classes are equally likely. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logweir.llm.common import HASHED_WORDS, WordHashes, lower_words, slices, trim_cache, typed
from logweir.llm.linear import hold_out
from logweir.session import materialise

TOP_WORDS = 32_000
SUFFIX_CLASSES = 512
STATES = 8
ROUNDS = 3
START_STEPS = 10
FORGET = 0.6             # a part of step k weighs (k + 1) ** -FORGET against all before
SEGMENT = 64
SEGMENTS = 2048          # segments in one step of the recursions
CHUNK = 4096             # classes in one message of expected counts
SMOOTH = 20.0
COUNTED_WORDS = 1 << 20  # distinct words that a task counts before it sends them
FOLDS, HELD = 7, 2


def suffix_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-3:]) % SUFFIX_CLASSES


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """hash, suffix, n of every word; each task sends a word once per million distinct ones."""
    fields = T.StructType.fromDDL("hash long, suffix int, n long")
    arrow = to_arrow_schema(fields)

    def message(counts: Counter) -> pa.RecordBatch:
        hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, counts)), np.int64)
        suffixes = np.fromiter(map(suffix_class, counts), np.int32, len(counts))
        numbers = np.fromiter(counts.values(), np.int64, len(counts))
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes), pa.array(suffixes), pa.array(numbers)], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    counts.update(lower_words(text))
                if len(counts) > COUNTED_WORDS:
                    yield message(counts)
                    counts.clear()
        if counts:
            yield message(counts)

    parts = docs.select(text_col).mapInArrow(run, fields)
    return parts.groupBy("hash").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"))


class Vocabulary:
    """Classes of words: own classes of frequent words, suffix classes, and the end."""

    def __init__(self, top: list[tuple[int, int]], suffixes: dict[int, tuple[int, int]], ends: int):
        self.top = {np.int64(h).tobytes(): k for k, (h, _) in enumerate(top)}
        self.own = len(top)
        self.end = self.own + SUFFIX_CLASSES
        self.size = self.end + 1
        self.counts = np.zeros(self.size)
        self.counts[: self.own] = [n for _, n in top]
        self.kinds = np.zeros(SUFFIX_CLASSES)
        for k, (total, kinds) in suffixes.items():
            self.counts[self.own + k], self.kinds[k] = total, kinds
        self.counts[self.end] = ends
        self.tokens = int(self.counts.sum())
        self.distinct = self.own + int(self.kinds.sum()) + (ends > 0)

    def base(self, count):
        """log10 of the base probability of a token with this count."""
        return np.log10((count + 1) / (self.tokens + self.distinct + 1))


class Codes(dict):
    """Class of a word as two bytes; bounded by ``trim``."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> bytes:
        own = self.vocabulary.top.get(xxhash.xxh64_digest(word))
        code = self.vocabulary.own + suffix_class(word) if own is None else own
        value = self[word] = code.to_bytes(2, "little")
        return value

    def trim(self) -> None:
        trim_cache(self, HASHED_WORDS)


def encode(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, held_out, classes (16-bit), base sums of classes with one word, and the other words."""
    fields = typed(
        "key long, doc_id long, held_out boolean, n_tokens long, classes binary, own_base double, "
        "own_known long, words array<struct<hash:long,suffix:int,tf:int>>",
        doc_id=docs.schema[id_col].dataType,
    )
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        codes, hashes = Codes(v), WordHashes()
        base = v.base(v.counts)
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch):
                codes.trim()
                hashes.trim()
                blobs, numbers, sums, known, keys = [], [], [], [], []
                rare_hash, rare_suffix, rare_tf, offsets = [], [], [], [0]
                for text in part.column(2).to_pylist():
                    found = lower_words(text)
                    classes = np.frombuffer(b"".join(map(codes.__getitem__, found)), "<u2")
                    rare = np.flatnonzero(classes >= v.own)
                    h, first, tf = np.unique(
                        hashes.of([found[k] for k in rare.tolist()]), return_index=True, return_counts=True
                    )
                    rare_hash.append(h.view(np.int64))
                    rare_suffix.append(classes[rare[first]].astype(np.int32) - v.own)
                    rare_tf.append(tf.astype(np.int32))
                    offsets.append(offsets[-1] + len(h))
                    own = classes[classes < v.own]
                    sums.append(float(base[own].sum() + base[v.end]))
                    known.append(len(own) + int(v.counts[v.end] > 0))
                    numbers.append(len(found) + 1)
                    blobs.append(classes.tobytes() + v.end.to_bytes(2, "little"))
                    keys.append(key)
                    key += 1
                words = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(np.concatenate(c)) for c in (rare_hash, rare_suffix, rare_tf)],
                        fields=list(arrow.field("words").type.value_type),
                    ),
                ).cast(arrow.field("words").type)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys), part.column(0), part.column(1), pa.array(numbers), pa.array(blobs, pa.binary()),
                    pa.array(sums), pa.array(known), words,
                ], schema=arrow)

    return docs.select(id_col, hold_out(id_col, FOLDS, HELD), text_col).mapInArrow(run, fields)


class Chain:
    """Start of documents and of cut segments, transitions, and class probabilities of each state."""

    def __init__(self, start, middle, moves, emits):
        self.start, self.middle, self.moves, self.emits = start, middle, moves, emits

    @classmethod
    def random(cls, states: int, shares: np.ndarray, seed: int = 11) -> Chain:
        draw = np.random.default_rng(seed)
        emits = shares * draw.uniform(0.5, 1.5, (states, len(shares)))
        moves = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        even = np.full(states, 1 / states)
        return cls(even, even.copy(), moves, emits / emits.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, counts: Counts, shares: np.ndarray) -> Chain:
        emits = counts.emits + SMOOTH * shares
        rows = [x + 0.1 for x in (counts.start, counts.middle)]
        moves = counts.moves + 0.1
        return cls(
            rows[0] / rows[0].sum(), rows[1] / rows[1].sum(), moves / moves.sum(1, keepdims=True),
            emits / emits.sum(1, keepdims=True),
        )

    def scores(self, classes: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of whole sequences, longest first in one scaled forward recursion."""
        out = np.zeros(len(classes))
        lengths = np.array([len(c) for c in classes])
        order = np.argsort(-lengths, kind="stable")
        by_class = np.ascontiguousarray(self.emits.T)
        flat = np.concatenate([classes[k] for k in order]) if len(order) else np.empty(0, int)
        begins = np.concatenate(([0], np.cumsum(lengths[order])))[:-1]
        left = -lengths[order]
        alpha = np.tile(self.start, (len(order), 1))
        total = np.zeros(len(order))
        for t in range(lengths.max() if len(order) else 0):
            live = int(np.searchsorted(left, -t))
            if t:
                alpha = alpha[:live] @ self.moves
            alpha = alpha * by_class[flat[begins[:live] + t]]
            scale = alpha.sum(1)
            total[:live] += np.log10(scale)
            alpha /= scale[:, None]
        out[order] = total
        return out


class Counts:
    """Expected counts of Baum-Welch."""

    def __init__(self, states: int, classes: int):
        self.start, self.middle = np.zeros(states), np.zeros(states)
        self.moves, self.emits = np.zeros((states, states)), np.zeros((states, classes))

    @classmethod
    def of(cls, start, middle, moves, emits) -> Counts:
        out = cls(*emits.shape)
        out.start, out.middle, out.moves, out.emits = start, middle, moves, emits
        return out

    def times(self, factor: float) -> Counts:
        return Counts.of(self.start * factor, self.middle * factor, self.moves * factor, self.emits * factor)

    def plus(self, other: Counts) -> Counts:
        return Counts.of(
            self.start + other.start, self.middle + other.middle, self.moves + other.moves, self.emits + other.emits
        )

    def add(self, chain: Chain, classes: list[np.ndarray]) -> None:
        pieces, first = [], []
        for c in classes:
            for at in range(0, len(c), SEGMENT):
                pieces.append(c[at : at + SEGMENT])
                first.append(at == 0)
        order = np.argsort([-len(p) for p in pieces], kind="stable").tolist()
        for at in range(0, len(order), SEGMENTS):
            chosen = order[at : at + SEGMENTS]
            self._segments(chain, [pieces[k] for k in chosen], np.array([first[k] for k in chosen]))

    def _segments(self, chain: Chain, pieces: list[np.ndarray], first: np.ndarray) -> None:
        """Forward and backward over segments, longest first, so that the live ones are a prefix."""
        lengths = np.array([len(p) for p in pieces])
        steps = int(lengths[0])
        live = [int(np.searchsorted(-lengths, -t)) for t in range(steps)]
        seen = np.zeros((steps, len(pieces)), np.int64)
        for k, p in enumerate(pieces):
            seen[: len(p), k] = p
        by_class = np.ascontiguousarray(chain.emits.T)
        emit = [by_class[seen[t, : live[t]]] for t in range(steps)]
        alpha, scale = [], []
        now = np.where(first[:, None], chain.start, chain.middle)
        for t in range(steps):
            if t:
                now = now[: live[t]] @ chain.moves
            now = now * emit[t]
            total = now.sum(1, keepdims=True)
            now = now / total
            alpha.append(now)
            scale.append(total)
        beta = np.ones_like(alpha[-1])
        classes = self.emits.shape[1]
        for t in range(steps - 1, -1, -1):
            if t < steps - 1:
                ahead = emit[t + 1] * beta / scale[t + 1]
                self.moves += chain.moves * (alpha[t][: live[t + 1]].T @ ahead)
                beta = np.concatenate([ahead @ chain.moves.T, np.ones((live[t] - live[t + 1], beta.shape[1]))])
            gamma = alpha[t] * beta
            alpha[t] = gamma
            if t == 0:
                self.start += gamma[first].sum(0)
                self.middle += gamma[~first].sum(0)
        gammas = np.concatenate(alpha)
        at = np.concatenate([seen[t, : live[t]] for t in range(steps)])
        for k in range(len(self.emits)):
            self.emits[k] += np.bincount(at, gammas[:, k], classes)


def _sequences(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2") for b in batch.column(column).to_pylist()]


def _start_chain(train: DataFrame, vocabulary: Vocabulary, shares: np.ndarray, states: int, steps: int = START_STEPS) -> Chain:
    """Stepwise Baum-Welch from a seeded random start: every training document is in one of the parts of one pass."""
    chain, mean = Chain.random(states, shares), None
    part = F.pmod(F.xxhash64(F.lit("start"), "doc_id", "classes"), F.lit(steps))
    for step in range(steps):
        counts = expected_counts(train.filter(part == step), chain)
        if counts is None:
            continue
        counts = counts.times(vocabulary.tokens / counts.emits.sum())
        share = (step + 1) ** -FORGET
        mean = counts if mean is None else mean.times(1 - share).plus(counts.times(share))
        chain = Chain.from_counts(mean, shares)
    return chain


def _unpacked(flat: np.ndarray, states: int) -> Chain:
    k = states
    return Chain(flat[:k], flat[k : 2 * k], flat[2 * k : 2 * k + k * k].reshape(k, k), flat[2 * k + k * k :].reshape(k, -1))


def expected_counts(train: DataFrame, chain: Chain, parts: int = 64) -> Counts | None:
    """Expected counts of all sequences, None without any; chunks of classes are summed over ``parts`` tasks each, then over all."""
    states, classes = chain.emits.shape
    shared = train.sparkSession.sparkContext.broadcast(chain)
    schema = "chunk int, part int, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(states, classes)
        for batch in batches:
            for piece in slices(batch):
                counts.add(shared.value, _sequences(piece, 0))
        if not counts.start.any():
            return
        part = TaskContext.get().partitionId() // parts
        flat = np.concatenate([counts.start, counts.middle, counts.moves.ravel(), counts.emits.ravel()])
        chunks = [flat[at : at + CHUNK].astype("<f4").tobytes() for at in range(0, len(flat), CHUNK)]
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array(range(len(chunks)), pa.int32()),
            "part": pa.array([part] * len(chunks), pa.int32()), "data": chunks,
        })

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, "<f4" if frame["part"].iloc[0] >= 0 else "<f8").astype(float)
                    for b in frame["data"])
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "part": [-1], "data": [total.tobytes()]})

    sums = train.select("classes").mapInArrow(run, schema)
    sums = sums.groupBy("chunk", "part").applyInPandas(add, schema)
    sums = sums.groupBy("chunk").applyInPandas(add, schema)
    rows = sorted(sums.select("chunk", "data").collect())  # states * classes numbers
    if not rows:
        return None
    found = _unpacked(np.concatenate([np.frombuffer(r.data) for r in rows]), states)
    return Counts.of(found.start, found.middle, found.moves, found.emits)


def baum_welch(train: DataFrame, chain: Chain, shares: np.ndarray, parts: int = 64) -> Chain:
    """One round over all training sequences."""
    counts = expected_counts(train, chain, parts)
    return chain if counts is None else Chain.from_counts(counts, shares)


def _vocabulary(counts: DataFrame, ends: int, top_words: int) -> tuple[Vocabulary, int]:
    """Classes of the words, and the least count of a word with its own class."""
    step = F.floor(F.log2("n") * 16)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("n").alias("least")).collect()
    least, held = 1 << 62, 0
    for r in sorted(sizes, key=lambda r: -r.step):
        held += r.n
        if held > top_words:
            break
        least = r.least
    top = counts.filter(F.col("n") >= least).select("hash", "n").collect()  # at most top_words
    rest = counts.filter(F.col("n") < least).groupBy("suffix").agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds")
    ).collect()
    suffixes = {r.suffix: (r.total, r.kinds) for r in rest}
    return Vocabulary(sorted((r.hash, r.n) for r in top), suffixes, ends), least


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES,
    rounds: int = ROUNDS, top_words: int = TOP_WORDS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    train_docs = docs.filter(~hold_out(id_col, FOLDS, HELD))
    counts = materialise(count_words(train_docs, text_col), "counts")
    vocabulary, least = _vocabulary(counts, train_docs.count(), top_words)
    shared = spark.sparkContext.broadcast(vocabulary)  # at most top_words words
    encoded = materialise(encode(docs, shared, id_col, text_col), "encoded")
    train = encoded.filter("not held_out")
    shares = (vocabulary.counts + 1) / (vocabulary.counts + 1).sum()
    chain = _start_chain(train, vocabulary, shares, states)
    for _ in range(rounds):
        chain = baum_welch(train, chain, shares)

    model = spark.sparkContext.broadcast(chain)
    fields = typed(
        "key long, doc_id long, held_out boolean, n_tokens long, own_base double, own_known long, chain double",
        doc_id=docs.schema[id_col].dataType,
    )
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(model.value.scores(_sequences(batch, 6)))], schema=arrow
            )

    chains = encoded.select(
        "key", "doc_id", "held_out", "n_tokens", "own_base", "own_known", "classes"
    ).mapInArrow(run, fields)

    totals = vocabulary.counts[vocabulary.own : vocabulary.end] + vocabulary.kinds + 1
    room = F.array(*[F.lit(float(x)) for x in totals])
    count = F.coalesce("n", F.lit(0)) + 1.0
    rare = encoded.select("key", F.explode("words").alias("w")).select("key", "w.*").join(
        counts.filter(F.col("n") < least).select("hash", "n"), "hash", "left"
    ).groupBy("key").agg(
        F.sum(F.col("tf") * F.log10(count / float(vocabulary.tokens + vocabulary.distinct + 1))).alias("rare_base"),
        F.sum(F.col("tf") * F.log10(count / room[F.col("suffix")])).alias("share"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf"))).alias("rare_known"),
    )
    zero = F.lit(0)
    return chains.join(rare, "key", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("own_known") + F.coalesce("rare_known", zero)).cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("own_base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("chain") + F.coalesce("share", zero)).alias("score"),
    )
