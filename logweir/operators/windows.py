"""Sliding windows over event sequences.

A window needs only its next h events, so a sequence is cut into blocks of positions and
the first h events of a block are also given to the block before it. Sessions of any
length are spread over tasks this way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

BLOCK = 65_536


def sliding_windows(
    seq: DataFrame, h: int = 10, step: int = 1, event: str = "event", block: int = BLOCK
) -> DataFrame:
    """(session_id, pos, window, next_event): h events and the one after them.

    A block is never shorter than the window, so the events a block needs lie in the next one.
    """
    block = max(block, h)
    home = F.floor(F.col("pos") / block)
    halo = (F.col("pos") % block < h) & (F.col("pos") >= block)
    copies = F.when(halo, F.array(home, home - 1)).otherwise(F.array(home))
    w = (
        W.partitionBy("session_id", "_block").orderBy("pos")
    )
    ahead = F.collect_list(event).over(w.rowsBetween(0, h))
    return (
        seq.select("session_id", "pos", event, home.alias("_home"), F.explode(copies).alias("_block"))
        .withColumn("_w", ahead)
        .filter(
            (F.col("_home") == F.col("_block"))
            & (F.size("_w") == h + 1)
            & (F.col("pos") % step == 0)
        )
        .select(
            "session_id",
            "pos",
            F.slice("_w", 1, h).alias("window"),
            F.element_at("_w", h + 1).alias("next_event"),
        )
    )


def short_sessions(seq: DataFrame, h: int = 10) -> DataFrame:
    """(session_id, n): sessions with at most h events, flagged without any window."""
    return (
        seq.groupBy("session_id").agg(F.count("*").alias("n")).filter(F.col("n") <= h)
    )


def distinct_windows(windows: DataFrame) -> DataFrame:
    """(window, next_event, n): scored once, weighted by n."""
    return windows.groupBy("window", "next_event").agg(F.count("*").alias("n"))


def window_counts(windows: DataFrame) -> DataFrame:
    """(window, event, cnt): quantity vector of every distinct window."""
    return (
        windows.select("window").distinct()
        .select("window", F.explode("window").alias("event"))
        .groupBy("window", "event").agg(F.count("*").alias("cnt"))
    )


def truncate(seq: DataFrame, size: int = 500) -> DataFrame:
    """The first ``size`` events of every session."""
    return seq.filter(F.col("pos") < size)


def event_arrays(seq: DataFrame, size: int = 500, event: str = "event") -> DataFrame:
    """(session_id, events): the truncated sequence as one array of at most ``size``."""
    return (
        truncate(seq, size).groupBy("session_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", event))).alias("_p"))
        .select("session_id", F.col(f"_p.{event}").alias("events"))
    )


def sequence_keys(seq: DataFrame, event: str = "event") -> DataFrame:
    """(session_id, n, seq_key): equal keys mean equal sequences.

    A sequence of any length is keyed by its length and a 128-bit sum of position-event
    hashes, which needs no collected row.
    """
    wide = F.lit(0).cast("decimal(38,0)")
    agg = seq.groupBy("session_id").agg(
        F.count("*").alias("n"),
        F.sum(wide + F.xxhash64("pos", event)).alias("_h1"),
        F.sum(wide + F.xxhash64(event, "pos", F.lit(1))).alias("_h2"),
    )
    return agg.select("session_id", "n", F.concat_ws(":", "n", "_h1", "_h2").alias("seq_key"))


def distinct_sequences(seq: DataFrame, event: str = "event") -> DataFrame:
    """(seq_key, n): multiplicity of every distinct sequence."""
    return sequence_keys(seq, event).groupBy("seq_key").agg(F.count("*").alias("n"))
