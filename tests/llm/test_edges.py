"""Every operator and stage: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from cases import DOCS, awkward_rows, table
from logweir.llm import (
    decontaminate, hidden_markov, language, line_templates, minhash, packing, personal_data, quality_classifier,
    quality_rules, repeats,
)

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, awkward_rows()).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k * 3, k % 2, 0) for k in range(17)] + [(3, None, 0), (None, 1, 0), (0, 0, 0), (0, 1, 1)]
    return spark.createDataFrame(rows, LABELS)


@pytest.fixture(scope="module")
def items(spark, docs):
    rows = [(1, "one"), (2, None), (3, ""), (None, "one two"), (4, "never seen words of an item"), (1, "one")]
    return spark.createDataFrame(rows, ITEMS)


def operators(labels, items):
    def classifier(d):
        return quality_classifier.quality_scores(d, quality_classifier.fit(d, labels))

    def tongue(d):
        return language.languages(d, language.fit(d))

    return {
        "rules": quality_rules.repetition_rules,
        "lines": lambda d: line_templates.drop_recurring_lines(d.select("doc_id", "text"), counts=True),
        "contamination": lambda d: decontaminate.contamination(d, items),
        "classifier": classifier,
        "markov": hidden_markov.score_documents,
        "minhash": minhash.near_duplicates,
        "repeats": repeats.remove_repeats,
        "language": tongue,
        "personal": personal_data.personal_data,
    }


def rows_of(df):
    # Floating-point sums may differ in the last places with the order of rows.
    return sorted(
        (tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str
    )


@pytest.mark.parametrize("name", list(operators(None, None)))
def test_awkward_rows_and_clashing_columns(spark, docs, labels, items, name):
    run = operators(labels, items)[name]
    plain = rows_of(run(docs))
    assert len(plain) == docs.count()
    assert sorted(str(r[0]) for r in plain) == sorted(str(r.doc_id) for r in docs.collect())
    clashing = docs
    for column in ("score", "found", "items", "words", "page", "key", "band", "kept", "row", "body", "_cut", "n", "id"):
        clashing = clashing.withColumn(column, F.lit("x"))
    assert rows_of(run(clashing.repartition(3))) == plain


@pytest.mark.parametrize("name", list(operators(None, None)))
def test_empty_table(spark, labels, items, name):
    assert operators(labels, items)[name](table(spark, [])).count() == 0


def test_packing_awkward_rows(docs):
    found = packing.pack(docs).collect()
    ends = [r for r in found if r.start + r.length == r.doc_tokens]
    assert len(ends) == docs.count()
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in ends)


def test_packing_empty_table(spark):
    assert packing.pack(table(spark, [])).count() == 0


def test_no_labels_no_items_no_languages(spark, docs):
    none = spark.createDataFrame([], LABELS)
    scores = quality_classifier.quality_scores(docs, quality_classifier.fit(docs, none))
    assert {r.score for r in scores.collect()} == {0.5}
    good = spark.createDataFrame([(3, 1, 0), (6, 1, 0)], LABELS)
    scores = quality_classifier.quality_scores(docs, quality_classifier.fit(docs, good))
    assert all(0.5 < r.score < 1 for r in scores.collect())
    found = decontaminate.contamination(docs, spark.createDataFrame([], ITEMS))
    assert not any(r.contaminated for r in found.collect())
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.languages(docs, language.fit(unknown)).collect()} == {("und", 0.0)}


def test_stages_keep_columns_and_bear_awkward_rows(spark, docs, labels, items, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, table(spark, []), str(tmp_path)).count() == 0, name
        extra = docs.withColumn("row", F.lit(1)).withColumn("_gone", F.lit(2)).withColumn("body", F.lit("b"))
        assert stage(spark, extra, str(tmp_path)).columns == extra.columns, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, str(tmp_path)).count() >= docs.count()


def test_defined_results_of_nulls(docs, items):
    rules = {r.doc_id: r for r in quality_rules.repetition_rules(docs).collect()}
    assert rules[0].n_words == 0 and rules[0].base_failed and not rules[0].kept
    near = minhash.near_duplicates(docs).collect()
    assert all(r.kept for r in near if r.doc_id is None)
    assert {r.n_shingles for r in near if r.doc_id in (0, 3, 6)} == {0}
    by_id = {r.doc_id: r for r in near}
    assert by_id[18].component_id == 15 and by_id[21].component_id == 15 and by_id[24].component_id == 24
    lines = line_templates.drop_recurring_lines(docs)
    assert [r.text for r in lines.collect() if r.doc_id == 0] == [None]
