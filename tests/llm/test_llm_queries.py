"""Registered queries on the smallest tables: the rows of their SQL where there is one."""

import glob
import os

import corpus_pipeline
import duckdb
import pytest

from logweir.llm.queries import ORACLES, QUERIES
from workload.check import normalise

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) >= (200 if name != "op11_collocations" else 0)
    if name in ORACLES:
        con = duckdb.connect()
        for path in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        want = con.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normalise(got) == normalise(want)


def test_pipeline(spark):
    found = corpus_pipeline.run(spark, SF).toPandas()
    assert found.groupby("sequence_id")["length"].sum().max() <= 4096
    ends = found[found.start + found.length == found.doc_tokens]
    assert ends["doc_id"].is_unique and len(ends) > 100


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert len([n for n in entry.queries() if n.startswith("op")]) == 13
