"""Text codecs of the intermediate files: labels, sequences, templates, vectors, results.

A session longer than ``PART`` items continues on further lines with the same key, in order, so no
task builds a line of unbounded length. Session ids are written as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from logweir.functions.text import tokens
from logweir.operators.sessions import ANOMALOUS

PART = 10_000
TEMPLATE_LINE = r"^\s*([^,]*),(.*?)\s*$"


def _matched(spark: SparkSession, path: str, pattern: str, *columns) -> DataFrame:
    """Fields of the lines that match; a field that cannot be cast is null."""
    line = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return line.select(*[
        F.regexp_extract("value", pattern, i + 1).try_cast(kind).alias(name)
        for i, (name, kind) in enumerate(columns)
    ])


def unmatched_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(value) of the lines that are not blank and do not match, for a report."""
    line = spark.read.text(path)
    return line.filter((F.trim("value") != "") & ~F.col("value").rlike(pattern))


def read_labels(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(session_id, label) of `block,label` or `block:label`; `Anomaly` becomes `Anomalous`."""
    pattern = rf"^\s*([^{sep}]*){sep}([^{sep}\s]*)"
    rows = _matched(spark, path, pattern, ("session_id", "string"), ("label", "string"))
    fixed = F.when(F.col("label") == "Anomaly", F.lit(ANOMALOUS)).otherwise(F.col("label"))
    return rows.withColumn("label", fixed)


def write_labels(labels: DataFrame, path: str, sep: str = ":") -> None:
    labels.select(F.concat_ws(sep, "session_id", "label")).write.text(path)


def _parts(seq: DataFrame, item: str) -> DataFrame:
    """(session_id, part, items): the text of every part of a sequence."""
    part = F.floor(F.col("pos") / PART)
    grouped = seq.groupBy("session_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col(item).cast("string").alias("i")))).alias("p")
    )
    return grouped.select("session_id", "part", F.array_join("p.i", " ").alias("items"))


def _write_in_order(parts: DataFrame, text, path: str) -> None:
    """The parts of a session stay together and in order, over the files in name order."""
    ordered = parts.repartitionByRange("session_id", "part").sortWithinPartitions("session_id", "part")
    ordered.select(text).write.text(path)


def write_sequences(seq: DataFrame, path: str, item: str = "log_id") -> None:
    """`session:id id …` lines of (session_id, pos, item)."""
    line = F.concat_ws(":", F.col("session_id").cast("string"), "items")
    _write_in_order(_parts(seq, item), line, path)


def read_sequences(
    spark: SparkSession, path: str, item: str = "log_id", kind: str = "bigint"
) -> DataFrame:
    """(session_id, pos, item) of `session:id id …` lines.

    The id ends at the first colon. Further lines of a session continue it in the order of the files
    and lines.
    """
    pattern = r"^([^:]*):(.*)$"
    place = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )
    rows = spark.read.text(path).select("value", place.alias("place")).filter(
        F.col("value").rlike(pattern)
    ).select(
        F.regexp_extract("value", pattern, 1).alias("session_id"), "place",
        tokens(F.regexp_extract("value", pattern, 2)).alias("items"),
    )
    earlier = W.partitionBy("session_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    before = rows.withColumn("before", F.coalesce(F.sum(F.size("items")).over(earlier), F.lit(0)))
    return before.select("session_id", "before", F.posexplode("items").alias("at", "i")).select(
        "session_id",
        (F.col("before") + F.col("at")).cast("bigint").alias("pos"),
        F.col("i").try_cast(kind).alias(item),
    )


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(template_id, template) of `id,template`; a template may hold commas."""
    return _matched(
        spark, path, TEMPLATE_LINE, ("template_id", "int"), ("template", "string")
    )


def write_templates(templates: DataFrame, path: str) -> None:
    templates.select(
        F.concat_ws(",", F.col("template_id").cast("string"), "template")
    ).write.text(path)


def read_log_events(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, template_id) of `log_id,template_id`."""
    return spark.read.csv(path, schema="log_id BIGINT, template_id INT")


def write_log_events(log_events: DataFrame, path: str) -> None:
    log_events.select("log_id", "template_id").write.csv(path)


def read_vectors(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(token, vec) of `word f1 … fd`.

    With ``header`` the first line is `n d`; only lines of d + 1 fields count and the first
    line of a word wins.
    """
    if not header:
        fields = spark.read.text(path).select(tokens("value").alias("f")).filter(F.size("f") > 0)
        return fields.select(
            F.col("f")[0].alias("token"), F.slice("f", 2, 2**31 - 1).cast("array<double>").alias("vec")
        )
    from logweir.sources.lines import read_log_lines

    lines = read_log_lines(spark, path).select("log_id", tokens("raw").alias("f"))
    dim = lines.filter(F.col("log_id") == 0).agg(F.max(F.col("f")[1].cast("int"))).scalar()
    body = lines.filter((F.col("log_id") > 0) & (F.size("f") == dim + 1))
    return (
        body.groupBy(F.col("f")[0].alias("token"))
        .agg(F.min_by("f", "log_id").alias("f"))
        .select("token", F.slice("f", 2, 2**31 - 1).cast("array<double>").alias("vec"))
    )


def write_vectors(vectors: DataFrame, path: str, key: str = "token") -> None:
    """`key f1 … fd` lines."""
    vectors.select(
        F.concat_ws(" ", F.col(key).cast("string"), F.array_join(F.col("vec").cast("array<string>"), " "))
    ).write.text(path)


def read_event_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(template_id, vec) of `id f1 … fd`."""
    return read_vectors(spark, path).select(F.col("token").cast("int").alias("template_id"), "vec")


def write_event_vectors(vectors: DataFrame, path: str) -> None:
    write_vectors(vectors, path, "template_id")


def write_instances(
    seq: DataFrame, sessions: DataFrame, path: str, item: str = "event"
) -> None:
    """Sequence line, then `id,label[,predicted,confidence]`, then a blank line.

    A session above ``PART`` items has several sequence lines before the one with its id.
    """
    fields = ["label"] + [c for c in ("predicted", "confidence") if c in sessions.columns]
    last = seq.groupBy("session_id").agg(F.floor(F.max("pos") / PART).alias("last"))
    rows = _parts(seq, item).join(
        sessions.select("session_id", *fields).join(last, "session_id"), "session_id"
    )
    tail = F.concat_ws(",", *[F.col(c).cast("string") for c in ("session_id", *fields)])
    line = F.when(F.col("part") < F.col("last"), F.col("items")).otherwise(
        F.concat(F.col("items"), F.lit("\n"), tail, F.lit("\n"))
    )
    _write_in_order(rows, line, path)


def write_pu_labels(labels: DataFrame, path: str) -> None:
    """`id predicted confidence` lines."""
    labels.select(
        F.concat_ws(" ", *[F.col(c).cast("string") for c in ("session_id", "predicted", "confidence")])
    ).write.text(path)


def read_pu_labels(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, predicted, confidence)."""
    return _matched(
        spark, path, r"^(\S+)\s+(\S+)\s+(\S+)\s*$",
        ("session_id", "string"), ("predicted", "string"), ("confidence", "double"),
    )


def missing_pu_labels(sessions: DataFrame, pu_labels: DataFrame) -> DataFrame:
    """Sessions the label file does not know."""
    return sessions.join(pu_labels.select("session_id"), "session_id", "left_anti")
