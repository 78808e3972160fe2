"""Ordered and shuffled splits, samples, vocabularies and event codes.

Numbering reads its input several times, so session tables (one row per session, small
next to the lines) are written once before they are numbered.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from logweir.operators.ranks import global_index, hash_index, sorted_index
from logweir.operators.sessions import ANOMALOUS, NORMAL
from logweir.session import materialise

SEED = 6


def _share(n, share: float):
    """int(share * n) in double arithmetic."""
    return F.floor(F.lit(float(share)) * n).cast("bigint")


def split_613(
    sessions: DataFrame, seed: int = SEED, train_fraction: float = 1.0
) -> DataFrame:
    """Adds `split` and `split_idx`: the first int(.7n) sessions are the pool, the rest test.

    The pool is shuffled; the part from int(.6n) on is dev, the part before it train. With
    ``train_fraction`` < 1 train keeps one contiguous slice of int(fraction * int(.6n))
    sessions at a seed-derived start, the other train sessions get split `unused`.
    """
    sessions = materialise(sessions, "sessions")
    n = sessions.agg(F.count("*")).scalar()
    ordered = global_index(sessions, "session_idx", ["session_id"], "_i")
    pool = ordered.filter(F.col("_i") < _share(n, 0.7)).drop("_i")
    test = ordered.filter(F.col("_i") >= _share(n, 0.7))
    shuffled = hash_index(pool, "session_id", seed, "split_idx")
    split = F.when(F.col("split_idx") >= _share(n, 0.6), "dev")
    if train_fraction < 1.0:
        train = _share(n, 0.6)
        size = _share(train, train_fraction)
        begin = slice_start(seed, train, size)
        split = split.when(
            (F.col("split_idx") >= begin) & (F.col("split_idx") < begin + size), "train"
        ).otherwise("unused")
    else:
        split = split.otherwise("train")
    return shuffled.withColumn("split", split).unionByName(
        test.withColumnRenamed("_i", "split_idx").withColumn("split", F.lit("test"))
    )


def slice_start(seed: int, train, size):
    """A start in [0, train - size) derived from the seed."""
    draw = int(hashlib.md5(str(seed).encode()).hexdigest()[:7], 16)
    return F.lit(draw).cast("bigint") % F.greatest(train - size, F.lit(1))


def split_82(sessions: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds `split`: train is the first ceil(.8n) sessions of the shuffled order."""
    sessions = materialise(sessions, "sessions")
    n = sessions.agg(F.count("*")).scalar()
    cut = F.ceil(F.lit(0.8) * n)
    return hash_index(sessions, "session_id", seed, "split_idx").withColumn(
        "split", F.when(F.col("split_idx") < cut, "train").otherwise("test")
    )


def normals(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("label") == NORMAL)


def sample_normals(sessions: DataFrame, share: float = 0.5, seed: int = SEED) -> DataFrame:
    """Exactly int(share * n) random normal sessions."""
    pool = materialise(normals(sessions), "normals")
    n = pool.agg(F.count("*")).scalar()
    return hash_index(pool, "session_id", seed, "_i").filter(F.col("_i") < _share(n, share)).drop("_i")


def labelled_normals(
    sessions: DataFrame, share: float = 0.5, order: str = "session_idx"
) -> DataFrame:
    """The first int(share * n) normal sessions in train order."""
    pool = materialise(normals(sessions), "normals")
    n = pool.agg(F.count("*")).scalar()
    ranked = global_index(pool, order, ["session_id"], "_i")
    return ranked.filter(F.col("_i") < _share(n, share)).drop("_i")


def label_distribution(sessions: DataFrame) -> DataFrame:
    """(split, normal, anomalous)."""
    return sessions.groupBy("split").agg(
        F.count_if(F.col("label") == NORMAL).alias("normal"),
        F.count_if(F.col("label") == ANOMALOUS).alias("anomalous"),
    )


def event_vocabulary(seq: DataFrame) -> DataFrame:
    """Distinct events."""
    return seq.select("event").distinct()


def event_index(
    train: DataFrame, test: DataFrame | None = None, order: str = "sorted"
) -> DataFrame:
    """(event, idx): train events sorted (or by first appearance), then new test events sorted."""
    if order == "first_seen":
        first = train.groupBy("event").agg(F.min(F.struct("session_idx", "pos")).alias("_at"))
        return sorted_index(first, "_at").drop("_at")
    events = event_vocabulary(train).withColumn("_part", F.lit(0))
    if test is not None:
        new = event_vocabulary(test).join(event_vocabulary(train), "event", "left_anti")
        events = events.unionByName(new.withColumn("_part", F.lit(1)))
    return sorted_index(events, "_part", "event").drop("_part")


def encode_sequences(seq: DataFrame, index: DataFrame) -> DataFrame:
    """Replace events by their code; an event outside the index gets code k."""
    k = index.agg(F.count("*")).scalar()
    return (
        seq.join(index, "event", "left")
        .withColumn("code", F.coalesce("idx", k).cast("int"))
        .drop("idx", "event")
    )


def build_vocabulary(vectors: DataFrame, token: str = "token", vec: str = "vec") -> DataFrame:
    """(idx, token, vec): four special rows, then the tokens; `<oov>` is the vector sum
    divided by the number of rows including the special ones."""
    from logweir.functions.vectors import sum_vectors

    n = vectors.agg(F.count("*")).scalar()
    names = F.array(*map(F.lit, ["<pad>", "<bos>", "<eos>", "<oov>"]))
    special = (
        sum_vectors(vectors, [], vec)
        .select((n + 4).alias("_rows"), vec, F.posexplode(names).alias("idx", token))
        .select(
            F.col("idx").cast("bigint").alias("idx"),
            token,
            F.transform(
                vec, lambda x: F.when(F.col(token) == "<oov>", x / F.col("_rows")).otherwise(0.0)
            ).alias(vec),
        )
    )
    slots = (
        vectors.select(token, vec)
        .withColumn("_slot", F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("bigint"))
    )
    words = global_index(slots, "_slot", [token], "idx").withColumn("idx", F.col("idx") + 4)
    return special.unionByName(words.select("idx", token, vec))
