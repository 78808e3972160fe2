import random
import re

import pytest
from pyspark.sql import functions as F

from logweir.functions import text as T
from logweir.operators.templates import (
    HDFS_TEMPLATES, hdfs_catalog, longest_literal, match_templates, prefix_pattern,
)
from logweir.sources.lines import read_log_lines


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_blank_line_keeps_its_number(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("a\n\nb\n")
    rows = read_log_lines(spark, str(path)).orderBy("log_id").collect()
    assert [(r["log_id"], r["raw"]) for r in rows] == [(0, "a"), (2, "b")]


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = [f"line {i}" if i % 7 else "" for i in range(3000)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.log").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = read_log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = {i: t for i, t in enumerate(lines + lines) if t}
    assert {r["log_id"]: r["raw"] for r in rows} == expected


def test_tokens_and_columns(spark):
    assert one(spark, "  a b \t c ", T.tokens("x")) == ["a", "b", "c"]
    assert one(spark, "a b c d", T.drop_columns("x", [0, 2])) == "b d"
    assert one(spark, "h a.b[c]", T.drop_columns("x", [0], clean=True)) == "abc"


@pytest.mark.parametrize("token, words", [
    ("HTTPServer", ["http", "server"]),
    ("addStoredBlock", ["add", "stored", "block"]),
    ("ID0x1", ["id", "0", "x", "1"]),
])
def test_camel(spark, token, words):
    assert one(spark, token, T.camel_words("x")) == words


def camel_model(token):
    """Words by the definition: classes are separator, digit, lower, other."""
    words, run, upper = [], "", False
    for ch in token:
        if ch in "-_":
            words, run, upper = words + [run], "", False
        elif ch.isdigit():
            words, run, upper = words + [run, ch], "", False
        elif ch.islower():
            if upper:
                words.append(run[:-1])
                run = run[-1]
            run, upper = run + ch, False
        else:
            if not upper:
                words, run = words + [run], ""
            run, upper = run + ch.lower(), True
    return [w for w in words + [run] if w.strip()]


def test_camel_random(spark):
    rng = random.Random(6)
    tokens = ["".join(rng.choice("abAB01-_.$") for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in tokens], "x string")
    for row in df.select("x", T.camel_words("x").alias("w")).collect():
        assert row["w"] == camel_model(row["x"]), row["x"]


def test_template_tokens(spark):
    text = "a_b, _x -y [c]=d/e #f|g h.$i"
    assert one(spark, text, T.template_tokens("x")) == ["a_b", "c", "d", "e", "f", "g", "h", "i"]


def test_masks(spark):
    line = 'blk_-12 10.0.0.1:80 at 10.0.0.2 id 0xfF 42 x7 executed cmd "rm a"'
    assert one(spark, line, T.mask("x")) == (
        "[ID] [IPANDPORT] at [IP] id [HEX] [NUM] x7 executed cmd [CMD]"
    )
    assert one(spark, "<a> 10.1.2.3 /usr/lib", T.mask("x", T.SPIRIT_MASKS)) == "[ID] [IP] [PATH]"


def test_mask_boundaries_match_python(spark):
    pattern = r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)"
    rng = random.Random(1)
    texts = ["".join(rng.choice("a1-+. 2é") for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for row in df.select("x", T.mask("x", [T.MASKS[6]]).alias("m")).collect():
        assert row["m"] == re.sub(pattern, "[NUM]", row["x"]), row["x"]


def test_keys(spark):
    lines = spark.createDataFrame(
        [(0, "blk_1 blk_-2 blk_1", "h"), (1, "no", "blk_9 h"), (2, "no", "no")],
        "log_id bigint, message string, raw string",
    )
    got = {(r["log_id"], r["key"]) for r in T.extract_keys(lines, "message", "raw").collect()}
    assert got == {(0, "blk_1"), (0, "blk_-2"), (1, "blk_9")}
    assert [r["log_id"] for r in T.unkeyed_lines(lines, "message", "raw").collect()] == [2]


def test_strict_timestamps(spark):
    rows = [
        (0, "- 1 2005.01.01 n1 x x 10:20:30 x x hello"),
        (1, "A 1 2005.13.01 n1 x x 10:20:30 x x bad month"),
        (2, "A 1 2005.01.01 n1 x x 10:20 x x bad time"),
        (3, "short"),
    ]
    lines = spark.createDataFrame(rows, "log_id bigint, raw string")
    got = T.parse_header(lines, strict_ts=True).collect()
    assert [(r["log_id"], r["message"], r["is_alert"]) for r in got] == [(0, "hello", False)]


def test_first_match_wins(spark):
    catalog = [(5, "abc (.*)"), (2, "a(.*)")]
    lines = spark.createDataFrame([("abc d",), ("ax",), ("zabc d",)], "message string")
    got = {r[0]: r[1] for r in match_templates(lines, catalog).collect()}
    assert got == {"abc d": 5, "ax": 2, "zabc d": None}


def test_patterns_equal_prefix_match(spark):
    """Rewritten patterns find the same lines as the plain ones, also on mutilated lines."""
    rng = random.Random(3)
    fill = ["", "blk_1", "10.0.0.1:5", "a b", "to", " to x", ":", "7", "-3"]
    texts = []
    for t in HDFS_TEMPLATES:
        for _ in range(12):
            s = re.sub(r"\(\.\*\)|\(\[-\]\?\[0-9\]\+\)", lambda m: rng.choice(fill), t).replace("\\", "")
            if rng.random() < 0.4 and s:
                at = rng.randrange(len(s))
                s = s[:at] + s[at + rng.randint(1, 4):]
            texts.append(s)
    df = spark.createDataFrame([(t,) for t in set(texts)], "message string")
    for row in match_templates(df, hdfs_catalog()).collect():
        want = next((i for i, p in hdfs_catalog() if re.match(p, row["message"])), None)
        assert row["template_id"] == want, row["message"]


def test_literals():
    assert longest_literal("(.*):Got x (.*)") == ":Got x "
    assert longest_literal("(.*)") == ""
    assert longest_literal("error[e]{0,1} (.*) ab") == " ab"
    assert prefix_pattern("a[b]? (.*)") == "(?d)^(?:a[b]? (.*))"


def test_large_catalogs_match_as_single_patterns_do(spark):
    import random
    import re

    from logweir.operators import templates as C

    rng = random.Random(3)
    words = ["open", "close", "a.b", "x(1)", "node", "fan", "err"]
    catalog = []
    for k in range(150):
        parts = [rng.choice([re.escape(rng.choice(words)), "(.*)", "([-]?[0-9]+)", "[a-c]+"]) for _ in range(rng.randint(1, 4))]
        catalog.append((1000 - k, " ".join(parts)))
    texts = [" ".join(rng.choice([*words, "17", "-4", "cab", ""]) for _ in range(rng.randint(0, 6))) for _ in range(600)] + [None, "", "a\nb open"]
    plain = [
        next((i for i, p in catalog if t is not None and re.match(p, t)), None) for t in texts
    ]
    matcher = C.CatalogMatcher(catalog)
    assert [matcher.match(t) for t in texts] == plain
    assert sum(len(matcher.candidates(t)) for t in texts if t) < 0.7 * len(texts) * len(catalog)
    lines = spark.createDataFrame([(k, t, "open") for k, t in enumerate(texts)], "log_id bigint, message string, raw string")
    found = {r["log_id"]: r["template_id"] for r in C.match_templates(lines.repartition(3), catalog).collect()}
    assert [found[k] for k in range(len(texts))] == plain
    one_by_one = lines.select("log_id", C.template_id_of(lines["message"], catalog).alias("t")).collect()
    assert {r["log_id"]: r["t"] for r in one_by_one} == found
    second = next((i for i, p in catalog if re.match(p, "open")), None)
    backed = {r["log_id"]: r["template_id"] for r in C.match_templates(lines, catalog, fallback_col="raw").collect()}
    assert all(backed[k] == (second if i is None else i) for k, i in enumerate(plain))


def test_large_catalogs_keep_few_tests(monkeypatch):
    import re

    from logweir.operators import templates as C

    monkeypatch.setattr(C, "TESTS_HELD", 10)
    catalog = [(k, f"(.*) block blk_{k} to (.*)" if k % 2 else f"block blk_{k} of ([-]?[0-9]+)") for k in range(300)]
    catalog += [(300, r"a\.b(.*)c"), (301, "(.*)xx(.*)x"), (302, "(.*)xx"), (303, r"(.*)\n(.*)y"), (304, "a(.*)xx(.*)")]
    texts = [f"the block blk_{k} to there" for k in range(0, 310)] + [f"block blk_{k} of {k}" for k in range(0, 310)] + [
        "a.b c", "axb c", "a.b\nc", "xxx", "\nxx", "x\nxxx", "", "a\nxx", "a xx", "z\ny", "block blk_1 to\n",
    ]
    matcher = C.CatalogMatcher(catalog)
    assert [matcher.match(t) for t in texts] == [next((i for i, p in catalog if re.match(p, t)), None) for t in texts]
    assert len(matcher.tests) <= 10


def test_a_catalog_beyond_the_bound_is_refused(spark, monkeypatch):
    import pytest

    from logweir.operators import templates as C

    monkeypatch.setattr(C, "CATALOG_BYTES", 10)
    with pytest.raises(ValueError, match="at most 10"):
        C.match_catalog(spark.createDataFrame([("x",)], "message string"), [(0, "a long template text")])
