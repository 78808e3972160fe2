"""One query per operator over its whole table, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.llm import hidden_markov, language, oracles, quality_classifier, toxicity
from logweir.llm.collocations import collocations
from logweir.llm.common import table
from logweir.llm.decontaminate import contamination
from logweir.llm.fill_in_middle import fill_in_middle, restored
from logweir.llm.line_templates import drop_recurring_lines
from logweir.llm.minhash import near_duplicates
from logweir.llm.packing import pack
from logweir.llm.personal_data import personal_data
from logweir.llm.quality_rules import repetition_rules
from logweir.llm.repeats import remove_repeats


def op1_quality_rules(spark, sf_dir):
    return repetition_rules(table(spark, sf_dir, "documents"))


def op2_line_templates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs, counts=True).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op3_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.quality_scores(docs, model)


def op5_hidden_markov(spark, sf_dir):
    return hidden_markov.score_documents(table(spark, sf_dir, "documents"))


def op6_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op7_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op8_repeats(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.languages(docs, language.fit(docs))


def op10_personal_data(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


def op12_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op13_fill_in_middle(spark, sf_dir):
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_line_templates, op3_decontaminate, op4_quality_classifier, op5_hidden_markov, op6_minhash, op7_pack, op8_repeats,
    op9_language, op10_personal_data, op11_collocations, op12_toxicity, op13_fill_in_middle,
)}
ORACLES = {
    "op1_quality_rules": oracles.QUALITY_RULES,
    "op2_line_templates": oracles.LINE_TEMPLATES,
    "op6_minhash": oracles.MINHASH,
    "op8_repeats": oracles.REPEATS,
    "op3_decontaminate": oracles.DECONTAMINATE,
    "op11_collocations": oracles.COLLOCATIONS,
    "op13_fill_in_middle": oracles.FILL_IN_MIDDLE,
}
