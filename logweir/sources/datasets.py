"""Data-set registry: file, header columns, encoding, session rule and template source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.functions import text as T
from logweir.operators import sessions as S
from logweir.operators.mining import MiningConfig, mine_templates
from logweir.operators.templates import match_templates
from logweir.session import materialise
from logweir.sources.lines import read_log_lines
from logweir.sources.tables import read_labels


@dataclass(frozen=True)
class DatasetSpec:
    """``rule`` is `key`, `node` or `global`; ``catalog`` replaces mining when given."""

    name: str
    rule: str
    drop: tuple[int, ...]
    encoding: str = "utf-8"
    key_regex: str = T.BLOCK_ID
    window: int = 120
    node_column: int = 3
    masks: tuple = tuple(T.MASKS)
    strict_ts: bool = False
    mining: MiningConfig = field(default_factory=MiningConfig)
    catalog: tuple | None = None
    template_encoding: Callable[[DataFrame], DataFrame] | None = None


# fixed values: the three data sets of the published evaluation
SPECS = {
    "HDFS": DatasetSpec("HDFS", "key", tuple(range(5)), mining=MiningConfig(4, 0.5)),
    "BGL": DatasetSpec("BGL", "node", tuple(range(9)), mining=MiningConfig(3, 0.1)),
    "Spirit": DatasetSpec(
        "Spirit", "global", tuple(range(9)), encoding="iso-8859-1",
        masks=tuple(T.SPIRIT_MASKS), strict_ts=True, mining=MiningConfig(4, 0.5),
    ),
}


@dataclass
class Dataset:
    lines: DataFrame
    members: DataFrame
    labels: DataFrame
    log_events: DataFrame
    sequences: DataFrame
    event_vectors: DataFrame | None = None

    def instances(self) -> DataFrame:
        """(session_id, n_events, label): sessions with events and a label."""
        sizes = self.sequences.groupBy("session_id").agg(F.count("*").alias("n_events"))
        return S.attach_labels(sizes, self.labels)


def load_dataset(
    spark: SparkSession, spec: DatasetSpec, path: str, labels_path: str | None = None
) -> Dataset:
    """Lines, sessions, labels, templates and event sequences of a log file."""
    raw = read_log_lines(spark, path, spec.encoding)
    if spec.rule == "key":
        lines = raw.withColumn("message", T.drop_columns("raw", spec.drop))
        members = held = S.sessions_by_key(lines, regex=spec.key_regex)
        labels = read_labels(spark, labels_path)
    else:
        lines = T.parse_header(raw, drop=spec.drop, node=spec.node_column, strict_ts=spec.strict_ts)
        by = "node" if spec.rule == "node" else None
        members = S.sessions_by_count(lines, spec.window, partition_by=by)
        # Labels and sequences share one numbering of the lines.
        held = materialise(members.select("session_id", "log_id", "is_alert"), "members")
        labels = S.label_any(held).select("session_id", "label")
    if spec.catalog is not None:
        matched = match_templates(lines, list(spec.catalog), fallback_col="raw")
        log_events = matched.filter(F.col("template_id").isNotNull()).select("log_id", "template_id")
        templates = None
    else:
        masked = materialise(lines.select("log_id", T.mask("message", spec.masks).alias("message")), "masked")
        mined = mine_templates(masked, spec.mining)
        log_events, templates = mined.log_events(masked), mined.templates
    vectors = None
    if spec.template_encoding is not None and templates is not None:
        vectors = spec.template_encoding(templates)
    sequences = S.event_sequences(held, log_events)
    return Dataset(lines, members, labels, log_events, sequences, vectors)
