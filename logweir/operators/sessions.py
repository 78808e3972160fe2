"""Sessions, event sequences and session labels.

Sessions are long tables: a member row is (session_id, log_id), a sequence row is
(session_id, pos, event). No row or task ever holds a whole session, so one session
may own a third of all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType

from logweir.functions.text import BLOCK_ID, extract_keys
from logweir.operators.ranks import global_index, key_index
from logweir.session import growing, materialise

NORMAL, ANOMALOUS = "Normal", "Anomalous"


def label_of(alert: Column) -> Column:
    return F.when(alert, F.lit(ANOMALOUS)).otherwise(F.lit(NORMAL))


def sessions_by_key(
    lines: DataFrame, message: str = "message", raw: str = "raw", regex: str = BLOCK_ID
) -> DataFrame:
    """Member rows: a line joins every session whose key it names, once."""
    return extract_keys(lines, message, raw, regex).select(
        F.col("key").alias("session_id"), "log_id", "key_ord"
    )


def session_index(members: DataFrame) -> DataFrame:
    """(session_id, session_idx): sessions numbered by first appearance."""
    tie = "key_ord" if "key_ord" in members.columns else None
    first = members.groupBy("session_id").agg(
        F.min(F.struct("log_id", F.col(tie) if tie else F.lit(0).alias("key_ord"))).alias("f")
    )
    first = first.select(
        "session_id", F.col("f.log_id").alias("first_log_id"), F.col("f.key_ord").alias("o")
    )
    first = materialise(first, "first-lines")
    return global_index(first, "first_log_id", ["o", "session_id"], "session_idx").select(
        "session_id", "first_log_id", "session_idx"
    )


def sessions_by_count(
    lines: DataFrame,
    size: int = 120,
    partition_by: str | None = None,
    order: str = "log_id",
) -> DataFrame:
    """Tumbling count windows over all lines or per entity; the last one may be short.

    Adds `session_id` and `pos` (0-based position inside the window).
    """
    if partition_by is None:
        ranked = global_index(lines, order, out="_i")
        sid = F.floor(F.col("_i") / size).cast("string")
    else:
        ranked = key_index(lines, partition_by, order, out="_i")
        sid = F.concat_ws(
            "_", F.col(partition_by).cast("string"), F.floor(F.col("_i") / size).cast("string")
        )
    return (
        ranked.withColumn("session_id", sid)
        .withColumn("pos", (F.col("_i") % size).cast("bigint"))
        .drop("_i")
    )


def epoch_seconds(lines: DataFrame, ts: str) -> Column:
    """Seconds since 1970; a timestamp without zone is taken as UTC in any session zone."""
    if isinstance(lines.schema[ts].dataType, TimestampNTZType):
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.floor(F.timestamp_diff("MICROSECOND", start, F.col(ts)) / 1_000_000)
    return F.unix_timestamp(ts)


def sessions_by_time(
    lines: DataFrame,
    seconds: int = 3600,
    origin: int = 0,
    partition_by: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Tumbling time windows from an origin; adds `window_start` (epoch) and `session_id`."""
    t = epoch_seconds(lines, ts)
    start = (F.floor((t - origin) / seconds) * seconds + origin).cast("bigint")
    out = lines.withColumn("window_start", start)
    parts = [F.col(partition_by).cast("string")] if partition_by else []
    return out.withColumn(
        "session_id", F.concat_ws("_", *parts, F.col("window_start").cast("string"))
    )


def label_any(
    members: DataFrame, alert: str = "is_alert", skip_first: bool = False, keys=("session_id",)
) -> DataFrame:
    """(session_id, n, label): Anomalous when any member line is an alert.

    ``skip_first`` ignores the first line of every window but the first one (needs
    `pos` and window ids that are numbers), the behaviour of global count windows.
    """
    flag = F.col(alert)
    if skip_first:
        flag = flag & ((F.col("session_id") == "0") | (F.col("pos") > 0))
    return members.groupBy(*keys).agg(
        F.count("*").alias("n"), label_of(F.max(flag)).alias("label")
    )


def event_sequences(
    members: DataFrame, log_events: DataFrame, event: str = "template_id"
) -> DataFrame:
    """(session_id, pos, event): events in line order; lines without a template go."""
    joined = growing(members.select("session_id", "log_id")).join(
        log_events.select("log_id", F.col(event).alias("event")), "log_id"
    )
    return key_index(joined, "session_id", "log_id").select("session_id", "pos", "event")


def attach_labels(sessions: DataFrame, labels: DataFrame, on: str = "session_id") -> DataFrame:
    """Sessions that have both events and a label."""
    return sessions.join(growing(labels), on)


def label_mismatches(sessions: DataFrame, labels: DataFrame, on: str = "session_id") -> DataFrame:
    """(id, side): ids found on one side only."""
    left, right = sessions.select(on).distinct(), labels.select(on).distinct()
    return left.join(right, on, "left_anti").withColumn("side", F.lit("no_label")).unionByName(
        right.join(left, on, "left_anti").withColumn("side", F.lit("no_events"))
    )
