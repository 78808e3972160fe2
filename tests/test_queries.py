"""Every query runs on the smallest data set and equals its SQL where there is one."""

import pytest

from workload.check import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF)


def test_all_queries(results):
    failed = {n: r for n, r in results.items() if r.startswith("FAIL")}
    assert not failed


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert set(df.columns) == {"session_id", "spe", "predicted", "label"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
