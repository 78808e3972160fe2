import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import ranks, sessions as S, splits as P, windows as G


@pytest.mark.parametrize("slice_rows", [10, 1_000_000])
def test_key_index_with_hot_key(spark, slice_rows):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"k{i % 9}", i * 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o bigint").repartition(5)
    got = ranks.key_index(df, "k", "o", slice_rows=slice_rows).collect()
    seen, expected = {}, {}
    for k, o in rows:
        expected[k, o] = seen.get(k, 0)
        seen[k] = expected[k, o] + 1
    assert {(r["k"], r["o"]): r["pos"] for r in got} == expected


@pytest.mark.parametrize("partitions", [1, 8])
def test_global_index(spark, partitions):
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("o")).repartition(partitions)
    got = ranks.global_index(df, "o", slices=7).collect()
    assert all(r["idx"] ** 2 == r["o"] for r in got)
    hashed = ranks.hash_index(df, "o", 6).orderBy("idx").collect()
    assert [r["idx"] for r in hashed] == list(range(1000))


def lines_of(spark, flags, node="n"):
    return spark.createDataFrame(
        [(i, node, f != "-") for i, f in enumerate(flags)], "log_id bigint, node string, is_alert boolean"
    )


def test_short_last_window(spark):
    m = S.sessions_by_count(lines_of(spark, "-" * 250), 120, partition_by="node")
    assert sorted(r["n"] for r in S.label_any(m).collect()) == [10, 120, 120]


def test_label_skip_first(spark):
    m = S.sessions_by_count(lines_of(spark, "--A-"), 2)
    get = lambda df: {r["session_id"]: r["label"] for r in df.collect()}
    assert get(S.label_any(m)) == {"0": "Normal", "1": "Anomalous"}
    assert get(S.label_any(m, skip_first=True)) == {"0": "Normal", "1": "Normal"}


def test_sequences_drop_unmatched(spark):
    members = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5), ("a", 7)], "session_id string, log_id bigint")
    events = spark.createDataFrame([(1, 10), (5, 20)], "log_id bigint, template_id int")
    got = {(r[0], r[1], r[2]) for r in S.event_sequences(members, events).collect()}
    assert got == {("a", 0, 10), ("a", 1, 20), ("b", 0, 20)}
    idx = {r["session_id"]: r["session_idx"] for r in S.session_index(members).collect()}
    assert idx == {"a": 0, "b": 1}


def sessions_of(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("s"), "id").alias("session_id"), F.col("id").alias("session_idx"),
        F.lit("Normal").alias("label"),
    )


@pytest.mark.parametrize("fraction, train", [(1.0, 60), (0.05, 3)])
def test_split_sizes(spark, fraction, train):
    got = P.split_613(sessions_of(spark, 100), train_fraction=fraction)
    sizes = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert (sizes["train"], sizes["dev"], sizes["test"]) == (train, 10, 30)
    assert sum(sizes.values()) == 100


@pytest.mark.parametrize("n", [90, 30, 7])
def test_split_uses_double_arithmetic(spark, n):
    got = P.split_613(sessions_of(spark, n)).filter("split = 'test'").count()
    assert got == n - int(0.7 * n)


def test_unseen_event_index(spark):
    train = spark.createDataFrame([("a", 0, 3), ("a", 1, 7)], "session_id string, pos bigint, event int")
    test = spark.createDataFrame([("b", 0, 9), ("b", 1, 7)], "session_id string, pos bigint, event int")
    index = {r["event"]: r["idx"] for r in P.event_index(train, test).collect()}
    assert index == {3: 0, 7: 1, 9: 2}
    codes = P.encode_sequences(test, P.event_index(train)).orderBy("pos").collect()
    assert [r["code"] for r in codes] == [2, 1]


def seq_of(spark, sessions):
    rows = [(s, i, e) for s, events in sessions.items() for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "session_id string, pos bigint, event int")


@pytest.mark.parametrize("block", [3, 4, 7, 65536])
@pytest.mark.parametrize("h, step", [(10, 1), (2, 1), (2, 3)])
def test_windows(spark, block, h, step):
    sessions = {"a": list(range(12)), "b": list(range(h)), "c": [1, 1, 2] * 15}
    got = G.sliding_windows(seq_of(spark, sessions), h, step, block=block).collect()
    want = {
        (s, i): (e[i:i + h], e[i + h])
        for s, e in sessions.items() for i in range(0, len(e) - h, step)
    }
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == want
    short = {r["session_id"] for r in G.short_sessions(seq_of(spark, sessions), h).collect()}
    assert short == {s for s, e in sessions.items() if len(e) <= h}


def test_sequence_keys(spark):
    long = list(range(1500))
    sessions = {"a": [1, 2], "b": [1, 2], "c": [2, 1], "d": long, "e": long, "f": long[::-1]}
    keys = {r["session_id"]: r["seq_key"] for r in G.sequence_keys(seq_of(spark, sessions)).collect()}
    assert keys["a"] == keys["b"] != keys["c"]
    assert keys["d"] == keys["e"] != keys["f"]
    cut = {r["session_id"]: len(r["events"]) for r in G.event_arrays(seq_of(spark, sessions)).collect()}
    assert cut == {"a": 2, "b": 2, "c": 2, "d": 500, "e": 500, "f": 500}


def test_sorted_index_with_several_files_per_task(spark):
    from logweir.operators.ranks import sorted_index

    spark.conf.set("spark.sql.files.maxRecordsPerFile", "100")
    try:
        got = sorted_index(spark.range(1000).selectExpr("999 - id AS v"), "v").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert all(r["idx"] == r["v"] for r in got) and len(got) == 1000


@pytest.mark.parametrize("kind", ["outlier", "ties", "nulls"])
def test_slices_are_even(spark, kind):
    """One far value, or a value that half of the rows share, leaves no slice above twice the mean."""
    rows = 20_000
    df = spark.range(rows).select(F.col("id").alias("t"), {
        "outlier": F.when(F.col("id") == 7, F.lit(10**15)).otherwise(F.col("id") * 3),
        "ties": F.when(F.col("id") % 2 == 0, F.lit(5)).otherwise(F.col("id")),
        "nulls": F.when(F.col("id") % 100 != 0, F.col("id") % 1000),
    }[kind].cast("bigint").alias("o")).repartition(5)
    _, sizes = ranks.cut_slices(df, "o", ["t"], slices=50)
    counts = [r["_n"] for r in sizes.collect()]
    assert sum(counts) == rows and max(counts) <= 2 * rows / 50
    got = ranks.global_index(df, "o", ["t"], slices=50).collect()
    want = sorted(((r["o"] is not None, r["o"] or 0, r["t"]) for r in got))
    assert [(r["o"] is not None, r["o"] or 0, r["t"]) for r in sorted(got, key=lambda r: r["idx"])] == want
    assert [r["idx"] for r in sorted(got, key=lambda r: r["idx"])] == list(range(rows))
