"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import quality_classifier
from logweir.llm.common import table
from logweir.llm.decontaminate import decontaminate
from logweir.llm.line_templates import drop_recurring_lines
from logweir.llm.minhash import deduplicate
from logweir.llm.packing import pack
from logweir.session import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.good_documents(docs, model)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; every document stays."""
    return drop_recurring_lines(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies (five-word shingles)."""
    return deduplicate(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark spans; documents that are mostly benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", unique_lines),
    ("near-duplicate removal", unlike_documents),
    ("benchmark decontamination", clean_of_benchmark),
    ("packing", packed),
]

# The classifier's scores and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
