"""MinHash near-dedup with sequential Bayesian verification.

1. A text becomes the set of its distinct word shingles. Equal sets are one class, told apart by 128-bit hashes.
2. Min-hash signatures are cut into bands. Classes that share a band are tied to the smallest one there, and the components of
   these ties are candidate groups: every banded candidate pair lies in one group.
3. Groups are cut into blocks, pairs of blocks are tasks. In a task, banded candidates are compared by batches of their signatures; a
   pair is pruned once the posterior probability of the wanted similarity (uniform prior) falls below ``MISS``. Survivors that are not
   connected yet are verified on the full sets, the most similar first.
4. Links connect classes; components carry the smallest id.

Only spanning links leave a task, so copies are never expanded into pairs. Groups above ``GROUP_BLOCKS`` blocks are cut by shared bands instead,
which gives the same candidates. At the wanted similarity a pair shares no band with probability (1 - s^r)^b, about 3e-6 by default.

Null texts and texts without words have empty sets and are linked with nothing. Rows with a null id are linked with nothing and
kept. Rows with the same id are linked, whatever their texts. Equal sets need no tie-breaking: the smallest id is kept. Extra columns are
kept by ``deduplicate`` and not read otherwise. Empty tables give empty results.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logweir.llm.common import Rolling, WordHashes, lower_words, map_rows, mix, typed
from logweir.llm.components import connected_components
from logweir.session import materialise

WIDTH = 5
PERCENT = 80
BANDS, ROWS = 32, 5
BATCH = 20               # signature places compared at a time
MISS = 1e-6              # posterior probability below which a pair is given up
BLOCK = 256              # members of a block
BLOCK_SHINGLES = 1 << 20
GROUP_BLOCKS = 16
TASK_SHINGLES = 1 << 22
BROADCAST_ROWS = 500_000

_factors = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes.trim()
    return np.unique(Rolling(hashes.of(words)).windows(min(width, len(words))))


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest value of the set under every factor (upper 32 bits)."""
    least = np.full(len(_factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, (found[at : at + 512, None] * _factors).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sign: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of one signature or of many."""
    parts = sign.reshape(*sign.shape[:-1], BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:-1]).copy()
    for k in range(ROWS):
        key = mix(key ^ parts[..., k]) + np.uint64(k)
    return key.view(np.int64)


def least_agreements(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """Per number of batches: fewer agreeing places than this end a pair.

    With a uniform prior and m of n places equal, P(similarity >= s) is the binomial tail sum over k <= m of C(n+1, k) s^k
    (1-s)^(n+1-k).
    """
    s, out = percent / 100, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss and m <= n:
            m += 1
            tail += comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
        out.append(m)
    return out


def _set_hash(found: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)


def describe(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, hash of the set (two numbers) and band keys of every row."""

    def row(hashes, doc_id, text):
        found = shingles(text, width, hashes)
        if not len(found):
            return doc_id, 0, None, None, None
        one, two = _set_hash(found).tolist()
        return doc_id, len(found), one, two, band_keys(signature(found)).tolist()

    fields = typed("doc_id long, n_shingles long, one long, two long, bands array<long>",
                   doc_id=docs.schema[id_col].dataType)
    return map_rows(docs.select(id_col, text_col), fields, row, WordHashes)


class Forest:
    """Union-find over the members of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def verify(signs: np.ndarray, sets: list[np.ndarray], pairs: np.ndarray, least: list[int], percent: int):
    """Spanning links of the candidate ``pairs`` (two columns of member numbers)."""
    agree = np.zeros(len(pairs), np.int64)
    sizes = np.array([len(s) for s in sets])
    small, large = np.sort(sizes[pairs], 1).T
    pairs, agree = (x[100 * small >= percent * large] for x in (pairs, agree))
    for k, fewest in enumerate(least):
        span = slice(k * BATCH, (k + 1) * BATCH)
        agree = agree + (signs[pairs[:, 0], span] == signs[pairs[:, 1], span]).sum(1)
        alive = agree >= fewest
        pairs, agree = pairs[alive], agree[alive]
    forest, links = Forest(len(sets)), []
    for k in np.argsort(-agree, kind="stable").tolist():
        x, y = pairs[k].tolist()
        p, q = forest.root(x), forest.root(y)
        if p == q:
            continue
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * both >= percent * (sizes[x] + sizes[y] - both):
            forest.up[p] = q
            links.append((x, y))
    return links


def candidates(bands: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Pairs that share a band: across the two blocks, or within the only one."""
    left, right = np.flatnonzero(block == block[0]), np.flatnonzero(block != block[0])
    alone = not len(right)
    right = left if alone else right
    shared = np.zeros((len(left), len(right)), bool)
    for k in range(BANDS):
        shared |= bands[left, k][:, None] == bands[right, k][None, :]
    if alone:
        shared = np.triu(shared, 1)
    i, j = np.nonzero(shared)
    return np.stack([left[i], right[j]], 1)


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast behind a count of its rows; joined by shuffles above."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _groups(classes: DataFrame) -> DataFrame:
    """group, id of all banded candidates (a group is a component of ties, or a band key where that is large)."""
    bands = materialise(
        classes.select("id", F.explode("bands").alias("band")), "bands"
    )
    heads = bands.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter(
        "n > 1"
    ).select("band", "head")
    shared = materialise(bands.join(heads, "band"), "shared")
    ties = shared.select(F.col("id").alias("a"), F.col("head").alias("b")).filter("a <> b").distinct()
    groups = connected_components(ties).select(
        F.col("node").alias("id"), F.col("component").alias("group")
    )
    large = groups.groupBy("group").agg(F.count("*").alias("n")).filter(
        F.col("n") > BLOCK * GROUP_BLOCKS
    ).select("group")
    large_ids = groups.join(large, "group", "left_semi").select("id")
    return materialise(
        groups.join(large, "group", "left_anti").select("group", "id").union(
            shared.join(large_ids, "id", "left_semi").select(F.col("band").alias("group"), "id")
        ), "groups",
    )


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """a, b: verified links of classes that connect what is linked (not every pair)."""
    groups = _groups(classes)
    grouped = materialise(
        classes.select("id", "doc").join(groups.select("id").distinct(), "id"), "grouped"
    )

    def row(hashes, _, text):
        found = shingles(text, width, hashes)
        one = int(_set_hash(found)[0]) if len(found) else None
        return one, len(found), signature(found).tobytes(), found.tobytes()

    chosen = docs.select(F.col(id_col).alias("doc"), text_col).join(
        _small(grouped.select("doc").distinct()), "doc", "left_semi"
    )
    sets = map_rows(
        chosen, T.StructType.fromDDL("id long, size long, sign binary, set binary"), row, WordHashes,
    ).join(_small(grouped.select("id")), "id", "left_semi").dropDuplicates(["id"])  # copies in repeated rows
    sets = materialise(sets, "sets")
    sizes = groups.join(sets.select("id", "size"), "id").groupBy("group").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks")
    )
    placed = groups.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).select(
        "group", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other")
    ).select(
        "id", "own", F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("pair"),
        (F.col("own") == F.col("other")).alias("within"),
    )
    total = sets.join(placed, "id").agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-total // TASK_SHINGLES), 4 * docs.sparkSession.sparkContext.defaultParallelism)
    least = least_agreements(percent)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby("pair", sort=False):
            if len(part) < 2:
                continue
            part = part.sort_values("id", kind="stable")
            ids = part["id"].to_numpy()
            signs = np.stack([np.frombuffer(b, np.uint32) for b in part["sign"]])
            found = [np.frombuffer(b, np.uint64) for b in part["set"]]
            block = part["own"].to_numpy()
            if not part["within"].iloc[0] and (block == block[0]).all():
                continue  # the other block of the pair is empty
            pairs = candidates(band_keys(signs), block)
            out += [(ids[x], ids[y]) for x, y in verify(signs, found, pairs, least, percent)]
        return pd.DataFrame(out, columns=["a", "b"])

    return placed.join(sets, "id").withColumn("task", F.pmod("pair", F.lit(tasks))).groupBy("task").applyInPandas(
        compare, "a long, b long"
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    known = materialise(describe(docs, width, id_col, text_col), "sets")
    full = known.filter(F.col("one").isNotNull() & F.col("doc_id").isNotNull())
    classes = full.groupBy("one", "two").agg(
        F.min("doc_id").alias("doc"), F.first("bands").alias("bands"), F.count("*").alias("copies")
    ).withColumn("id", F.col("one"))
    classes = materialise(classes, "classes")
    edges = links(docs, classes, width, percent, id_col, text_col)
    # Rows of one id with different sets are linked.
    heads = full.groupBy("doc_id").agg(F.min("one").alias("b"), F.max("one").alias("last")).filter(
        "b < last"
    ).select("doc_id", "b")
    again = full.join(heads, "doc_id").select(F.col("one").alias("a"), "b")
    components = connected_components(edges.union(again))
    linked = components.join(classes.select(F.col("id").alias("node"), "doc"), "node")
    least = linked.groupBy("component").agg(F.min("doc").alias("least"))
    label = linked.join(least, "component").select(F.col("node").alias("one"), "least")
    # Rows outside any link or copy keep their own id, so only the others are looked up.
    multiple = materialise(
        classes.join(label, "one", "left").filter((F.col("copies") > 1) | F.col("least").isNotNull()).select(
            "one", "two", F.coalesce("least", "doc").alias("component_id")
        ), "labels",
    )
    found = known.join(multiple, ["one", "two"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; all columns kept.

    Of several rows of a kept id the one with the smallest row hash stays. Rows without an id have no component: of
    those with one text one stays, and none if a row with an id has that text; without a word they all stay.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).filter(~F.col("kept")).select(
        F.col("doc_id").alias(id_col)
    )
    gone = materialise(gone.distinct(), "gone")
    named = docs.filter(F.col(id_col).isNotNull()).join(_small(gone), id_col, "left_anti").select(docs.columns)
    again = materialise(
        docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").select(id_col),
        "repeated",
    )
    out = named
    if not again.isEmpty():
        some = _small(again)
        out = named.join(some, id_col, "left_anti").select(docs.columns).unionByName(
            _one_each(named.join(some, id_col, "left_semi").select(docs.columns), F.col(id_col))
        )
    nameless = docs.filter(F.col(id_col).isNull())
    if nameless.isEmpty():
        return out
    digest, wordless = F.sha2(F.col(text_col), 256), ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    unique = _one_each(nameless.filter(~wordless), digest)
    seen = docs.filter(F.col(id_col).isNotNull()).select(digest.alias("_digest"))
    held = unique.join(seen, digest == F.col("_digest"), "left_anti")
    return out.unionByName(held).unionByName(nameless.filter(wordless))


def _one_each(rows: DataFrame, key: Column) -> DataFrame:
    """The row with the smallest hash for each key, picked with partial aggregation."""
    whole = F.struct(*(F.col(c) for c in rows.columns))
    best = rows.groupBy(key.alias("_key")).agg(F.min_by(whole, F.xxhash64(whole)).alias("_row"))
    return best.select("_row.*")
