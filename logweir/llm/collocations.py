"""Phrase collocation mining with weighted acyclic automata.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends and pieces into words. For every language, phrases of 2 to
``WIDTH`` words with at least ``min_count`` occurrences are scored by how much more often they occur than their parts would by chance, at
their weakest cut; phrases that (almost) only occur inside a longer one are dropped.

1. Word counts per language. A bit table of the hashes of frequent words and then one of frequent neighbouring pairs (``BITS`` bits each,
   whatever the input) tell which places can begin a phrase; a wrongly set bit only lets more through.
2. Each task sorts the n-grams that begin at those places, one of up to ``WIDTH`` words per place, and builds count transducers of
   ``BLOCK`` n-grams each. The count of a phrase is the sum over the n-grams it begins, so one n-gram per place serves all lengths.
3. Transducers are cut at the borders of prefix ranges of about ``RANGE`` n-grams, taken from the blocks' first n-grams; each range is united
   in one task. A hot first word, pair or longer prefix spans several ranges, and its sums over them are added.
4. The parts of all candidates are made into transducers as well and composed with the ranges they can lie in, which gives the
   counts of the parts; single words have theirs from step 1.

Null texts count as empty; a null language is ``und``. Repeated rows count as often as they occur. Ids and extra columns are not read. Texts are
read whole, about ``PIECE`` bytes at a time, cut at ends of pieces. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from logweir.llm.common import mix, slices
from logweir.llm.transducer import CountTransducer, count_rows
from logweir.session import materialise

WIDTH = 5
MIN_COUNT = 100
TOP = 2000
INSIDE = 100          # a phrase goes if a longer one has this many per cent of its count
BITS = 26             # bit tables of frequent words and pairs: 8 MB each
BLOCK = 1 << 13
RANGE = 1 << 20
BUFFER = 1 << 20      # n-grams, pairs or words that a task collects before it counts them
CACHED = 1 << 18
PIECE = 1 << 20
SALTS = 64
SEED = 42             # of Spark's xxhash64

_BREAK = b"\xff"      # never part of UTF-8
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)


def tokens(text: str):
    """Lists of lower-case words with a break mark between the pieces of a text."""
    raw = text.encode().lower().translate(_TABLE)
    at = 0
    while at < len(raw):
        to = raw.find(_BREAK, at + PIECE)
        to = len(raw) if to < 0 else to
        yield raw[at:to].replace(_BREAK, b" \xff ").split(), at == 0
        at = to + 1


def language_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), SEED)


def _language():
    return F.coalesce(F.col("lang"), F.lit("und"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of all words; the row with a null word has the number of all occurrences."""
    schema = "lang string, word string, n long"
    arrow = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        from collections import Counter

        held: dict[str, Counter] = {}
        totals: Counter = Counter()

        def rows():
            for lang, counter in held.items():
                counter.pop(_BREAK, None)
                names = [w.decode() for w in counter]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()),
                     pa.array(list(counter.values()), pa.int64())], schema=arrow,
                )
            held.clear()

        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    counter = held.setdefault(lang, Counter())
                    for found, _ in tokens(text or ""):
                        counter.update(found)
                        totals[lang] += len(found) - found.count(_BREAK)
                if sum(map(len, held.values())) > CACHED:
                    yield from rows()
        yield from rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()),
             pa.array(list(totals.values()), pa.int64())], schema=arrow,
        )

    return texts.mapInArrow(count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bit_table(keys: DataFrame, key: str) -> np.ndarray:
    """2 ** BITS bits as bytes, those of the keys' low bits set; at most 2 ** BITS / 8 bytes reach the driver."""
    place = F.col(key).bitwiseAND(F.lit((1 << BITS) - 1))
    parts = keys.select(place.alias("place")).groupBy(F.shiftright("place", 15).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")
    )
    table = np.zeros(1 << (BITS - 3), np.uint8)
    for row in parts.toLocalIterator():
        table[row.bucket << 12 : (row.bucket + 1) << 12] = np.frombuffer(row.bits, np.uint8)
    return table


def bits_set(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64((1 << BITS) - 1)
    return (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Vocabulary(dict):
    """Numbers of the words of one language that may be frequent; -1 for all others and for breaks."""

    def __init__(self, lang: str, frequent: np.ndarray):
        self.lang, self.seed, self.frequent = lang, language_seed(lang), frequent
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.names: list[bytes] = []
        self.hashes: list[int] = []
        self.hash_array = np.empty(0, np.uint64)
        self[_BREAK] = -1

    def __missing__(self, word: bytes) -> int:
        key = xxhash.xxh64_intdigest(word, self.seed)
        place = key & ((1 << BITS) - 1)
        if self.frequent[place >> 3] >> (place & 7) & 1:
            value = len(self.names)
            self.names.append(word)
            self.hashes.append(key)
        else:
            value = -1
        self[word] = value
        return value

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def pair_keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if len(self.hash_array) != len(self.hashes):
            self.hash_array = np.array(self.hashes, np.uint64)
        return mix(mix(self.hash_array[left]) + self.hash_array[right])

    def trim(self) -> bool:
        """Forget the infrequent words of a full cache; true if the frequent ones fill it."""
        if len(self) > CACHED:
            for word in [w for w, k in self.items() if k < 0 and w != _BREAK]:
                del self[word]
        return len(self) > CACHED


def frequent_pairs(texts: DataFrame, frequent, min_count: int) -> DataFrame:
    """Keys of pairs of neighbours that occur often enough; both words may be frequent."""
    arrow = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def count(batches):
        vocabularies: dict[str, Vocabulary] = {}
        held, size = [], 0

        def rows():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], schema=arrow)

        for vocabulary, numbers, _ in _numbered(batches, frequent.value, vocabularies):
            at = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
            held.append(vocabulary.pair_keys(numbers[at], numbers[at + 1]))
            size += len(at)
            if size > BUFFER:
                yield rows()
                held, size = [], 0
            if vocabulary.trim():
                vocabulary.clear_all()
        if held:
            yield rows()

    return (
        texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= min_count)
    )


def _numbered(batches, frequent: np.ndarray, vocabularies: dict[str, Vocabulary]):
    """(vocabulary, word numbers, last of its slice) of the texts, several short ones at a time."""
    for batch in batches:
        for part in slices(batch):
            by_lang: dict[str, list] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if lang not in vocabularies:
                    vocabularies[lang] = Vocabulary(lang, frequent)
                for found, _ in tokens(text or ""):
                    held = by_lang.setdefault(lang, [])
                    held += found
                    held.append(_BREAK)
                    if len(held) > CACHED:
                        yield vocabularies[lang], vocabularies[lang].numbers(held), False
                        by_lang[lang] = []
            for lang, held in by_lang.items():
                if held:
                    yield vocabularies[lang], vocabularies[lang].numbers(held), True


def order_key(words) -> bytes:
    """Bytes that sort as the tuples of words do."""
    return b"\x00".join(w.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") for w in words)


def shard_transducers(texts: DataFrame, frequent, pairs, width: int) -> DataFrame:
    """(lang, low, high, grams, body): count transducers of blocks of sorted n-grams of every shard."""
    schema = "lang string, low binary, high binary, grams long, body binary"

    def build(batches):
        vocabularies: dict[str, Vocabulary] = {}
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def blocks(lang):
            rows = np.concatenate(held.pop(lang))
            sizes[lang] = 0
            vocabulary = vocabularies[lang]
            used = np.unique(rows[rows >= 0])
            order = sorted(used.tolist(), key=lambda k: vocabulary.names[k])
            rank = np.full(len(vocabulary.names) + 1, -1, np.int32)   # the last place serves -1
            rank[order] = np.arange(len(order))
            rows, counts = count_rows(rank[rows], np.ones(len(rows), np.int64))
            names = [vocabulary.names[k] for k in order]
            for at in range(0, len(rows), BLOCK):
                yield transducer_row(lang, names, rows[at : at + BLOCK], counts[at : at + BLOCK])

        for vocabulary, numbers, _ in _numbered(batches, frequent.value, vocabularies):
            lang = vocabulary.lang
            rows = phrase_rows(vocabulary, numbers, pairs.value, width)
            if len(rows):
                held.setdefault(lang, []).append(rows)
                sizes[lang] = sizes.get(lang, 0) + len(rows)
            full = vocabulary.trim()
            if held.get(lang) and (full or sizes[lang] > BUFFER):
                yield from blocks(lang)
            if full:
                vocabulary.clear_all()
        for lang in list(held):
            yield from blocks(lang)

    return texts.mapInArrow(build, schema)


def phrase_rows(vocabulary: Vocabulary, numbers: np.ndarray, pairs: np.ndarray, width: int) -> np.ndarray:
    """The n-gram of up to ``width`` words at each place whose word may belong with the next one."""
    both = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
    linked = np.zeros(len(numbers) + width, bool)
    linked[both] = bits_set(pairs, vocabulary.pair_keys(numbers[both], numbers[both + 1]))
    starts = np.flatnonzero(linked)
    rows = np.full((len(starts), width), -1, np.int32)
    rows[:, 0] = numbers[starts]
    alive = np.ones(len(starts), bool)
    for k in range(1, width):
        alive &= linked[starts + k - 1]
        rows[alive, k] = numbers[starts[alive] + k]
    return rows


def transducer_row(lang: str, names: list[bytes], rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row with the transducer of some sorted n-grams over its own words."""
    used = np.unique(rows[rows >= 0])
    rank = np.full(len(names) + 1, -1, np.int32)
    rank[used] = np.arange(len(used))
    symbols = [names[k] for k in used.tolist()]
    rows = rank[rows]
    low, high = (order_key(symbols[k] for k in rows[at].tolist() if k >= 0) for at in (0, -1))
    body = CountTransducer.build(symbols, rows, counts).to_bytes()
    return pa.RecordBatch.from_arrays(
        [pa.array([lang]), pa.array([low], pa.binary()), pa.array([high], pa.binary()), pa.array([len(rows)], pa.int64()),
         pa.array([body], pa.binary())], names=["lang", "low", "high", "grams", "body"],
    )


def range_borders(blocks: DataFrame, size: int = RANGE) -> list[tuple[str, bytes]]:
    """First (language, key) of every range but the first: one short key per ``size`` n-grams of all shards."""
    total = blocks.agg(F.sum("grams")).first()[0] or 0
    ranges = -(-total // size)
    if ranges < 2:
        return []

    def least(frames):
        best = None
        for frame in frames:
            for pair in zip(frame["lang"], frame["low"]):
                best = pair if best is None or pair < best else best
        if best:
            yield pd.DataFrame([best], columns=["lang", "low"])

    found = blocks.select("lang", "low").repartitionByRange(int(ranges), "lang", "low").mapInPandas(
        least, "lang string, low binary"
    )
    return sorted((r.lang, bytes(r.low)) for r in found.collect())[1:]


def cut_at_borders(blocks: DataFrame, borders, width: int) -> DataFrame:
    """(range, lang, body): blocks dealt to ranges; those that cross a border are cut there."""

    def cut(batches):
        edges = borders.value
        for batch in batches:
            for lang, low, high, body in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                one, last = bisect_right(edges, (lang, low)), bisect_right(edges, (lang, high))
                if one == last:
                    yield _range_row(one, lang, body)
                    continue
                whole = CountTransducer.from_bytes(body)
                rows, counts = whole.grams(width)
                keys = [order_key(whole.symbols[s] for s in r if s >= 0) for r in rows.tolist()]
                at = 0
                for number in range(one, last + 1):
                    to = bisect_left(keys, edges[number][1]) if number < last else len(keys)
                    if to > at:
                        piece = transducer_row(lang, whole.symbols, rows[at:to], counts[at:to])
                        yield _range_row(number, lang, piece.column(4)[0].as_py())
                    at = to

    return blocks.mapInArrow(cut, "range int, lang string, body binary")


def _range_row(number: int, lang: str, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int32()), pa.array([lang]), pa.array([body], pa.binary())], names=["range", "lang", "body"]
    )


def unite(cut: DataFrame, width: int, min_count: int) -> DataFrame:
    """(range, lang, body): one transducer per range and language of what can still be frequent.

    Prefixes of the first and the last n-gram of a range may go on in other ranges and stay whatever their count.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        symbols, rows, counts = CountTransducer.summed([CountTransducer.from_bytes(b) for b in frame["body"]], width)
        rows, counts = prune(rows, counts, min_count)
        body = CountTransducer.build(symbols, rows, counts).to_bytes()
        return pd.DataFrame([(frame["range"].iloc[0], frame["lang"].iloc[0], body)], columns=["range", "lang", "body"])

    return cut.groupBy("range", "lang").applyInPandas(run, "range int, lang string, body binary")


def prune(rows: np.ndarray, counts: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams cut to their longest prefix that is frequent or one of the border's."""
    keep = np.zeros(rows.shape, bool)
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for d in range(rows.shape[1]):
        new[1:] |= rows[1:, d] != rows[:-1, d]
        group = np.cumsum(new) - 1
        total = np.zeros(group[-1] + 1, np.int64) if len(rows) else np.zeros(0, np.int64)
        np.add.at(total, group, counts)
        edge = (group == 0) | (group == group[-1]) if len(rows) else np.zeros(0, bool)
        keep[:, d] = (rows[:, d] >= 0) & ((total[group] >= min_count) | edge)
    keep = np.logical_and.accumulate(keep, 1)
    return count_rows(np.where(keep, rows, -1).astype(np.int32), counts)


def phrase_counts(models: DataFrame, width: int, min_count: int) -> DataFrame:
    """(lang, phrase, words, n) of all frequent phrases of two words and more."""
    arrow = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])

    def read(batches):
        for batch in batches:
            for lang, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                model = CountTransducer.from_bytes(body)
                for d, (rows, weight) in enumerate(model.prefixes(width)):
                    if d:
                        names = [b" ".join(model.symbols[s] for s in r[: d + 1]).decode() for r in rows.tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()),
                             pa.array([d + 1] * len(names), pa.int32()), pa.array(weight, pa.int64())], schema=arrow,
                        )

    return (
        models.mapInArrow(read, "lang string, phrase string, words int, n long")
        .groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    )


def part_counts(parts: DataFrame, models: DataFrame, borders, width: int) -> DataFrame:
    """(lang, part, n) of parts of two words and more: transducers of the parts composed with those of the ranges."""

    def deal(batches):
        edges = borders.value
        for batch in batches:
            out = []
            for lang, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = order_key(part.encode().split(b" "))
                # All n-grams that begin with the part lie from its own key to before key + 0x01.
                for number in range(bisect_right(edges, (lang, key)), bisect_left(edges, (lang, key + b"\x01")) + 1):
                    out.append((number, lang, part))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                    names=["range", "lang", "part"],
                )

    def look_up(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame([], columns=["lang", "part", "n"], dtype=object)
        phrases = [p.encode().split(b" ") for p in asked["part"]]
        symbols = sorted({w for p in phrases for w in p})
        number = {w: k for k, w in enumerate(symbols)}
        rows = np.full((len(phrases), width), -1, np.int32)
        for k, phrase in enumerate(phrases):
            rows[k, : len(phrase)] = [number[w] for w in phrase]
        rows, counts = count_rows(rows, np.ones(len(rows), np.int64))
        found = CountTransducer.from_bytes(held["body"].iloc[0]).compose(CountTransducer.build(symbols, rows, counts))
        lang = asked["lang"].iloc[0]
        return pd.DataFrame([(lang, p.decode(), n) for p, n in found], columns=["lang", "part", "n"], dtype=object)

    dealt = parts.mapInArrow(deal, "range int, lang string, part string")
    return (
        dealt.groupBy("range", "lang").cogroup(models.groupBy("range", "lang"))
        .applyInPandas(look_up, "lang string, part string, n long")
        .groupBy("lang", "part").agg(F.sum("n").alias("n"))
    )


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
    width: int = WIDTH, inside: int = INSIDE, range_size: int = RANGE,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language."""
    scored = scored_phrases(docs, text_col, lang_col, min_count, width, inside, range_size)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(
        F.col("rank") <= top
    )
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def scored_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, width: int = WIDTH,
    inside: int = INSIDE, range_size: int = RANGE,
) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all phrases that are frequent and not inside a longer one."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).select(_language().alias("lang"), "text")
    words = materialise(word_counts(texts).filter(F.col("word").isNull() | (F.col("n") >= min_count)), "words")
    single = words.filter(F.col("word").isNotNull())
    frequent = context.broadcast(bit_table(single.select(F.xxhash64("lang", "word").alias("key")), "key"))
    pairs = context.broadcast(bit_table(frequent_pairs(texts, frequent, min_count), "key"))
    blocks = materialise(shard_transducers(texts, frequent, pairs, width), "transducers")
    borders = context.broadcast(range_borders(blocks, range_size))
    models = materialise(unite(cut_at_borders(blocks, borders, width), width, min_count), "ranges")
    phrases = materialise(phrase_counts(models, width, min_count), "phrases")

    tokens_of = F.split("phrase", " ")
    cuts = phrases.select(
        "lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(tokens_of, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(tokens_of, F.col("k") + 1, F.col("words")), " ").alias("tail"),
    )
    longer = cuts.select("lang", F.explode(F.array("head", "tail")).alias("part")).filter(F.col("part").contains(" ")).distinct()
    counts = materialise(
        part_counts(longer, models, borders, width)
        .unionByName(single.select("lang", F.col("word").alias("part"), "n")), "parts",
    )
    big = "decimal(38,0)"
    score = F.expr(f"(cast(1000 as {big}) * cast(a as decimal(18,0)) * cast(n as decimal(18,0))) div "
                   "(cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    totals = words.filter(F.col("word").isNull()).select("lang", F.col("n"))
    weakest = (
        cuts.join(counts.select("lang", F.col("part").alias("head"), F.col("n").alias("l")), ["lang", "head"])
        .join(counts.select("lang", F.col("part").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
        .join(totals, "lang")
        .withColumn("score", score)
        .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    # Counts only fall as a phrase grows, so the phrases one word longer decide for all longer ones.
    within = (
        phrases.filter("words > 2")
        .select("lang", "n", F.explode(F.array(
            F.array_join(F.slice(tokens_of, F.lit(1), F.col("words") - 1), " "),
            F.array_join(F.slice(tokens_of, F.lit(2), F.col("words") - 1), " "),
        )).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    )
    return (
        weakest.join(within, ["lang", "phrase"], "left")
        .filter(F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("a")))
        .select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                F.col("cut.score").alias("score"))
    )
