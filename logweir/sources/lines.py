"""Raw text logs with stable line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from logweir.functions.text import WHITESPACE, is_alert
from logweir.session import materialise

# Up to this many input splits their offsets (16 bytes each) are broadcast; joined by a shuffle above.
BROADCAST_SPLITS = 5_000_000


def read_log_lines(
    spark: SparkSession, path: str, encoding: str = "utf-8"
) -> DataFrame:
    """(log_id, raw): 0-based line numbers over all files of ``path`` in name order.

    Blank lines use up a number and yield no row. The text is read once: lines are written with a
    number that rises inside their file block, and the counts of the earlier blocks are added to what was
    written, so another packing of the splits cannot move a number. The block table has one row per
    input split, no line passes a single task.
    """
    value = F.col("value")
    if encoding.lower().replace("-", "").replace("_", "") not in ("utf8",):
        value = F.decode(value.cast("binary"), encoding)
    raw = F.regexp_replace(value, f"^{WHITESPACE}+|{WHITESPACE}+$", "")
    text = materialise(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_mid"),
            raw.alias("raw"),
        ).withColumn("_block", F.xxhash64("_file", "_start")), "lines",
    )
    blocks = text.groupBy("_file", "_start").agg(
        F.min("_mid").alias("_first"), F.count("*").alias("_n"), F.first("_block").alias("_block")
    )
    before = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialise(blocks.select(
        "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    ), "offsets")
    if offsets.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return (
        text.join(offsets, "_block")
        .select((F.col("_mid") + F.col("_shift")).alias("log_id"), "raw")
        .filter(F.col("raw") != "")
    )


def write_log_lines(lines: DataFrame, path: str) -> None:
    """Write (log_id, raw) as text in line order, by ranges of line numbers."""
    lines.repartitionByRange("log_id").sortWithinPartitions("log_id").select("raw").write.text(path)


def head_extract(lines: DataFrame, n: int = 1_200_000) -> DataFrame:
    """The lines with a number below n."""
    return lines.filter(F.col("log_id") < n)


def alert_count(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """(total, alerts) of the lines."""
    return lines.agg(
        F.count("*").alias("total"), F.count_if(is_alert(raw)).alias("alerts")
    )
