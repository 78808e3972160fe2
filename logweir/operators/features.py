"""Count, tf-idf and semantic features of sessions and templates.

Features stay long tables (session_id, event, x); a dense vector per session is only
built at the edge of a model, where its width is the size of the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from logweir.functions.columns import explode_once, once
from logweir.functions.text import camel_words, template_tokens
from logweir.functions.vectors import sum_vectors, vector_size
from logweir.session import materialise

OOV = "<oov>"
# Widest dense form of a vocabulary (a width x width matrix is 512 MB of doubles here).
MAX_WIDTH = 8192
FREQUENT_BYTES = 1 << 24


def check_width(width: int) -> None:
    if width > MAX_WIDTH:
        raise ValueError(f"{width} events; fold rare ones (oov, min_count) below {MAX_WIDTH}")


def event_counts(seq: DataFrame) -> DataFrame:
    """(session_id, event, cnt): absent pairs count 0."""
    return seq.groupBy("session_id", "event").agg(F.count("*").alias("cnt"))


def session_count(counts: DataFrame) -> Column:
    return counts.select("session_id").distinct().agg(F.count("*")).scalar()


def fit_idf(counts: DataFrame, n_sessions: Column | None = None) -> DataFrame:
    """(event, df, idf) with idf = ln(N / (df + 1e-8))."""
    n = session_count(counts) if n_sessions is None else n_sessions
    return (
        counts.groupBy("event")
        .agg(F.count("*").alias("df"))
        .withColumn("idf", F.log(n / (F.col("df") + F.lit(1e-8))))
    )


def tfidf(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(session_id, event, x): count times idf; events without an idf go."""
    return counts.join(idf.select("event", "idf"), "event").select(
        "session_id", "event", (F.col("cnt") * F.col("idf")).alias("x")
    )


def column_means(x: DataFrame, n_sessions: Column | None = None) -> DataFrame:
    """(event, mean): column mean over all sessions, zeros included."""
    n = session_count(x) if n_sessions is None else n_sessions
    return x.groupBy("event").agg((F.sum("x") / n).alias("mean"))


def zero_mean(
    x: DataFrame, means: DataFrame, sessions: DataFrame | None = None
) -> DataFrame:
    """(session_id, event, x): dense table minus the train means.

    Zeros become non-zero, so every session carries the whole vocabulary: one array of
    (event, mean) pairs per row is laid beside the counts of the session and exploded. Like
    every dense form it is limited to ``MAX_WIDTH`` events. ``sessions`` adds the sessions
    without any known event.
    """
    check_width(means.count())
    vocabulary = means.agg(F.array_sort(F.collect_list(F.struct("event", "mean")))).scalar()
    sparse = x.groupBy("session_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event", "x"))).alias("_x")
    )
    if sessions is not None:
        sparse = sessions.select("session_id").distinct().join(sparse, "session_id", "left")
    return sparse.select("session_id", "_x", F.explode(vocabulary).alias("m")).select(
        "session_id",
        F.col("m.event").alias("event"),
        (F.coalesce(F.element_at("_x", F.col("m.event")), F.lit(0.0)) - F.col("m.mean")).alias("x"),
    )


def sigmoid(x: DataFrame) -> DataFrame:
    """Logistic function on the non-zero entries only."""
    return x.withColumn(
        "x", F.when(F.col("x") != 0, 1 / (1 + F.exp(-F.col("x")))).otherwise(F.col("x"))
    )


def frequent_events(counts: DataFrame, min_count: int) -> DataFrame:
    """Events found in at most ``min_count`` - 1 sessions are left out."""
    return (
        counts.groupBy("event").agg(F.count("*").alias("df"))
        .filter(F.col("df") >= min_count).select("event")
    )


def fold_unseen(counts: DataFrame, events: DataFrame, oov: bool = False) -> DataFrame:
    """Keep the counts of known events; with ``oov`` the number of distinct other events
    of a session becomes its `<oov>` count."""
    known = counts.join(events.select("event"), "event", "left_semi")
    if not oov:
        return known
    other = (
        counts.join(events.select("event"), "event", "left_anti")
        .groupBy("session_id").agg(F.count("*").alias("cnt"))
        .select("session_id", F.lit(OOV).alias("event"), "cnt")
    )
    return known.withColumn("event", F.col("event").cast("string")).unionByName(other)


@dataclass
class CountModel:
    """Fitted count features: vocabulary with idf and means as one small table."""

    table: DataFrame
    weighting: str | None
    normalisation: str | None
    oov: bool

    @staticmethod
    def fit(
        seq: DataFrame,
        weighting: str | None = None,
        normalisation: str | None = None,
        oov: bool = False,
        min_count: int = 1,
    ) -> "CountModel":
        counts = event_counts(seq)
        n = session_count(counts)
        if oov:
            counts = fold_unseen(counts, frequent_events(counts, min_count), oov=True)
        table = fit_idf(counts, n)
        if oov:
            # Unseen events of later sessions need the entry even if no train event was rare.
            entry = seq.sparkSession.range(1).select(
                F.lit(OOV).alias("event"), F.lit(0).cast("bigint").alias("df"),
                F.log(n / F.lit(1e-8)).alias("idf"),
            )
            table = table.unionByName(entry.join(table, "event", "left_anti"))
        if normalisation == "zero-mean":
            x = (
                tfidf(counts, table) if weighting == "tf-idf"
                else counts.withColumn("x", F.col("cnt").cast("double"))
            )
            table = table.join(column_means(x, n), "event", "left").fillna(0.0, ["mean"])
        return CountModel(materialise(table, "count-model"), weighting, normalisation, oov)

    def transform(self, seq: DataFrame) -> DataFrame:
        """(session_id, event, x) with the train vocabulary."""
        counts = event_counts(seq)
        events = self.table.filter(F.col("event").cast("string") != OOV)
        counts = fold_unseen(counts, events, self.oov)
        if self.weighting == "tf-idf":
            x = tfidf(counts, self.table)
        else:
            x = counts.select("session_id", "event", F.col("cnt").cast("double").alias("x"))
        if self.normalisation == "zero-mean":
            x = zero_mean(x, self.table.select("event", "mean"), seq)
        elif self.normalisation == "sigmoid":
            x = sigmoid(x)
        return x


def dense_vectors(x: DataFrame, events: list, sessions: DataFrame | None = None) -> DataFrame:
    """(session_id, vec): one column per vocabulary event, in the order of ``events``.

    ``sessions`` adds all-zero vectors for sessions without any known event.
    """
    check_width(len(events))
    wide = x.groupBy("session_id").pivot("event", events).agg(F.first("x"))
    columns = [F.coalesce(F.col(f"`{e}`"), F.lit(0.0)) for e in events]
    out = wide.select("session_id", F.array(*columns).alias("vec"))
    if sessions is not None:
        zero = F.array(*[F.lit(0.0)] * len(events))
        out = sessions.select("session_id").distinct().join(out, "session_id", "left").select(
            "session_id", F.coalesce("vec", zero).alias("vec")
        )
    return out


# ---- templates ----------------------------------------------------------------------


def token_counts(templates: DataFrame, template: str = "template") -> DataFrame:
    """(template_id, token, cnt, n_tokens)."""
    toks = once(templates.select("template_id", template), "t", template_tokens(template))
    return (
        explode_once(
            toks.select("template_id", F.size("t").alias("n_tokens"), "t"),
            "template_id", "n_tokens", name="token", values=F.col("t"),
        )
        .groupBy("template_id", "n_tokens", "token")
        .agg(F.count("*").alias("cnt"))
        .select("template_id", "token", "cnt", "n_tokens")
    )


def token_idf(templates: DataFrame, template: str = "template") -> DataFrame:
    """(token, cnt, idf) with idf = ln(T / occurrences); occurrences, not templates."""
    occurrences = explode_once(templates, name="token", values=template_tokens(template))
    return _idf(
        occurrences.groupBy("token").agg(F.count("*").alias("cnt")),
        templates.agg(F.count("*")).scalar(),
    )


def _idf(counts: DataFrame, n_templates: Column) -> DataFrame:
    return counts.withColumn("idf", F.log(n_templates / F.col("cnt")))


def sub_words(tokens: DataFrame) -> DataFrame:
    """(token, word, times): camel words of every distinct token with multiplicity."""
    return (
        explode_once(
            tokens.select("token").distinct(), "token", name="word", values=camel_words("token")
        )
        .groupBy("token", "word").agg(F.count("*").alias("times"))
    )


def word_vectors_mean(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """(token, vec): sum of the found sub-word vectors over the number of sub-words.

    Tokens without any known word are absent (a zero vector adds nothing).
    """
    words = sub_words(tokens)
    totals = words.groupBy("token").agg(F.sum("times").alias("n_words"))
    found = words.join(vectors.select(F.col("token").alias("word"), "vec"), "word")
    summed = sum_vectors(found, ["token"], "vec", F.col("times"))
    return summed.join(totals, "token").select(
        "token", F.transform("vec", lambda v: v / F.col("n_words")).alias("vec")
    )


def oov_rate(templates: DataFrame, vectors: DataFrame, template: str = "template") -> DataFrame:
    """(missing, total): sub-word lookups without a vector, over token occurrences."""
    occurrences = token_counts(templates, template).groupBy("token").agg(F.sum("cnt").alias("c"))
    words = sub_words(occurrences).join(occurrences, "token")
    known = vectors.select(F.col("token").alias("word"), F.lit(1).alias("known"))
    n = F.col("times") * F.col("c")
    return words.join(known, "word", "left").agg(
        F.coalesce(F.sum(F.when(F.col("known").isNull(), n)), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total"),
    )


def _frequent_sums(weighted: DataFrame, vectors: dict, size: int) -> DataFrame:
    """(template_id, vec): x times the vectors of the given tokens, added per template and batch of rows."""
    place = {token: k for k, token in enumerate(vectors)}
    matrix = np.array([*vectors.values()], float).reshape(-1, size)
    shared = weighted.sparkSession.sparkContext.broadcast((place, matrix))
    schema = StructType([weighted.schema["template_id"], StructField("vec", ArrayType(DoubleType()))])

    def run(batches):
        places, table = shared.value
        for batch in batches:
            token = batch.column(1).dictionary_encode()
            at = np.array([places.get(t, -1) for t in token.dictionary.to_pylist()], np.int64)
            at = at[token.indices.to_numpy(zero_copy_only=False)] if len(at) else at
            use = np.flatnonzero(at >= 0)
            if not len(use):
                continue
            owner = batch.column(0).take(pa.array(use)).dictionary_encode(null_encoding="encode")
            group = owner.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.diff(group[order], prepend=-1))
            x = batch.column(2).to_numpy(zero_copy_only=False)[use[order]]
            total = np.add.reduceat(x[:, None] * table[at[use[order]]], first, axis=0)
            yield pa.RecordBatch.from_arrays(
                [owner.dictionary, pa.array(list(total), pa.list_(pa.float64()))], ["template_id", "vec"]
            )

    return weighted.mapInArrow(run, schema)


def template_vectors(
    templates: DataFrame, vectors: DataFrame, template: str = "template", frequent_bytes: int = FREQUENT_BYTES
) -> DataFrame:
    """(template_id, vec): sum of tf * idf * word vector over token occurrences.

    A token that occurs c times adds c * (c / n). Templates without tokens get zeros. The vectors of the most frequent tokens
    (``frequent_bytes`` of them) go to every task; only occurrences of the others carry their vector through a shuffle.
    """
    size = vector_size(vectors)
    # Rows of one template lie together, so that the vectors of frequent tokens are added where they are.
    counts = materialise(
        token_counts(templates, template).repartition("template_id").sortWithinPartitions("template_id"), "token-counts"
    )
    idf = _idf(
        counts.groupBy("token").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("rows")),
        templates.agg(F.count("*")).scalar(),
    )
    words = materialise(
        idf.join(word_vectors_mean(counts, vectors), "token").select(
            "token", "rows", F.transform("vec", lambda v: v * F.col("idf")).alias("vec")
        ),
        "token-vectors",
    )
    frequent = words.orderBy(F.desc("rows"), "token").limit(frequent_bytes // (8 * max(size, 1))).collect()
    weighted = counts.select("template_id", "token", (F.col("cnt") * F.col("cnt") / F.col("n_tokens")).alias("x"))
    parts = _frequent_sums(weighted, {r["token"]: r["vec"] for r in frequent}, size)
    known = templates.sparkSession.createDataFrame([(r["token"],) for r in frequent], "token string")
    rare = words.join(F.broadcast(known), "token", "left_anti").select("token", "vec")
    parts = parts.unionByName(sum_vectors(weighted.join(rare, "token"), ["template_id"], "vec", F.col("x")))
    summed = sum_vectors(parts, ["template_id"], "vec")
    zero = F.array(*[F.lit(0.0)] * size)
    return templates.select("template_id").join(summed, "template_id", "left").select(
        "template_id", F.coalesce("vec", zero).alias("vec")
    )


def sequence_vectors(
    seq: DataFrame, event_vectors: DataFrame, sessions: DataFrame | None = None
) -> DataFrame:
    """(session_id, vec): sum of the event vectors over occurrences, unknown events ignored."""
    size = vector_size(event_vectors)
    weighted = event_counts(seq).join(event_vectors.select("event", "vec"), "event")
    out = sum_vectors(weighted, ["session_id"], "vec", F.col("cnt"))
    ids = (sessions if sessions is not None else seq).select("session_id").distinct()
    zero = F.array(*[F.lit(0.0)] * size)
    return ids.join(out, "session_id", "left").select(
        "session_id", F.coalesce("vec", zero).alias("vec")
    )


def mean_vector(event_vectors: DataFrame) -> DataFrame:
    """One row with the mean event vector."""
    return sum_vectors(event_vectors, [], "vec", mean=True)
