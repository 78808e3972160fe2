"""Operators against brute-force versions, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import awkward_rows, edited, prose, table
from logweir.llm import (
    decontaminate, hidden_markov, language, line_templates, linear, minhash, packing, personal_data, quality_classifier,
    quality_rules, repeats,
)

WORD = re.compile("[^\x20\x09-\x0D]+")


def corpus(n: int = 120) -> list[tuple]:
    """Prose with copies, shared passages and edits."""
    draw, rows = random.Random(3), []
    passage = prose(999, 70)
    for k in range(n):
        text = prose(k, draw.randrange(5, 120))
        if k % 5 == 0:
            at = text.split()
            text = " ".join([*at[: len(at) // 2], passage if k % 10 else passage[:90], *at[len(at) // 2 :]])
        if k % 7 == 0 and k:
            text = edited(rows[k // 2][1], k, draw.randrange(0, 6))
        rows.append((k * 2 + 1, text.replace(" w1", "\nw1"), None, None, 0))
    return rows + [r for r in awkward_rows() if r[0] is None or r[0] % 2 == 0]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(5).cache()


def one_each(rows):
    return {r[0]: r[1] or "" for r in rows if r[0] is not None}


def test_repeats_against_brute_force(docs, rows):
    texts = {k: WORD.findall(t) for k, t in one_each(rows).items()}
    first = {}
    for k in sorted(texts):
        for i in range(len(texts[k]) - 12):
            first.setdefault(tuple(texts[k][i : i + 13]), k)
    found = {r.doc_id: r for r in repeats.remove_repeats(docs, page_bytes=3000).collect() if r.doc_id is not None}
    for k, words in texts.items():
        gone = set()
        for i in range(len(words) - 12):
            if first[tuple(words[i : i + 13])] < k:
                gone |= set(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (found[k].n_words, found[k].n_removed) == (len(words), len(gone)), k
        assert found[k].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def components_of(sets, percent):
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("width,block,group_blocks", [(4, 256, 16), (5, 4, 16), (4, 4, 1)])
def test_minhash_against_all_pairs(docs, rows, monkeypatch, width, block, group_blocks):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "GROUP_BLOCKS", group_blocks)
    sets = {}
    for k, t in one_each(rows).items():
        w = [x.decode() for x in t.encode().lower().split()]
        n = min(width, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    want = components_of(sets, 80)
    for r in minhash.near_duplicates(docs, width=width).collect():
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash_links_a_chain_inside_a_hot_group(spark):
    base = prose(1, 200)
    chain = [base]
    for k in range(25):
        chain.append(edited(chain[-1], k, 2))
    found = minhash.near_duplicates(table(spark, [(k, t, None, None, 0) for k, t in enumerate(chain)])).collect()
    assert {r.component_id for r in found} == {0}


def test_minhash_links_rows_of_one_id(spark):
    one, two = prose(1, 60), prose(2, 60)
    rows = [(5, one), (5, two), (3, edited(one, 1, 1)), (9, two), (9, two), (4, prose(3, 60)), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs, width=4).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == sorted(
        [("5", "3")] * 2 + [("3", "3")] + [("9", "3")] * 2 + [("4", "4"), ("None", "None")]
    )


def test_posterior_bounds_rise():
    least = minhash.least_agreements()
    assert least == sorted(least) and least[-1] < 160 * 0.8


def test_decontamination_against_brute_force(spark, docs, rows):
    normal = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    passage = prose(999, 70).split()
    items = [
        (10, " ".join(passage[5:20])), (9, " ".join(passage[10:13])), (2, passage[3].upper()), (7, "absent words"),
        (11, " ".join(passage[:9]) + "!"), (12, None), (100, prose(2, 40)), (1, prose(2, 40)),
    ]
    table_ = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: normal.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    for options in ({}, {"block_words": 5}):
        found = defaultdict(list)
        for r in decontaminate.contamination(docs, table_, **options).collect():
            found[r.doc_id].append(r)
        for k, text in one_each(rows).items():
            w, hit, held = words(text), set(), set()
            for item, body in items:
                v = words(body)
                n = min(10, len(v))
                windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
                for i in range(len(w) - n + 1):
                    if n and tuple(w[i : i + n]) in windows:
                        hit |= set(range(i, i + n))
                        held.add(str(item))
            digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
            for r in found[k]:
                assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(held), digest)
                assert r.contaminated == bool(hit)


def test_decontaminated_documents_hold_no_window(spark, docs):
    items = spark.createDataFrame([(1, prose(999, 70))], "item_id long, text string")
    clean = decontaminate.decontaminate(docs, items, max_coverage=0.5)
    assert not any(r.contaminated for r in decontaminate.contamination(clean, items).collect())
    before = {r.doc_id: r.text for r in docs.collect()}
    hit = {r.doc_id for r in decontaminate.contamination(docs, items).collect() if r.contaminated}
    assert all(r.text == before[r.doc_id] for r in clean.collect() if r.doc_id not in {*hit, None})


def test_quality_rules_against_brute_force(docs, rows):
    found = {r.doc_id: r for r in quality_rules.repetition_rules(docs).collect()}
    for k, text in one_each(rows).items():
        words = WORD.findall(text)

        def inside(n):
            seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
            return {j for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}

        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = found[k]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(inside(8))
        for n in quality_rules.NGRAM_LIMITS:
            assert r[f"dup_chars_{n}"] == sum(len(words[j]) for j in inside(n))
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
        assert not (r.base_failed and r.kept)


def test_recurring_templates_go_and_copies_stay(spark):
    notice = "Page {} was printed on day {} by user u{}@mail for all"
    rows = [(k, f"{prose(k, 30)}\n{notice.format(k, k * 7, k)}\n{prose(k + 500, 30)}") for k in range(12)]
    copied = prose(77, 30) + "\n" + prose(78, 30)
    rows += [(100 + k, copied) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs, counts=True).collect()}
    for k, text in rows:
        lines = text.split("\n")
        want = [lines[0], lines[2]] if k < 100 else lines
        assert found[k].text == "\n".join(want)
        assert found[k].n_lines == len(lines) and found[k].n_dropped == len(lines) - len(want)


@pytest.mark.parametrize("n", [50, 1000, 50_000])
def test_a_template_family_goes_at_any_size(spark, n):
    texts = F.concat(
        F.concat_ws(" ", *[F.concat(F.lit("w"), F.translate(F.md5(F.concat("id", F.lit(f"-{k}"))), "0123456789", "ghijklmnop")) for k in range(6)]),
        F.lit("\nWe all welcome name"), F.translate((F.col("id") % 100).cast("string"), "0123456789", "abcdefghij"),
        F.lit(" from city"), F.translate(((F.col("id") * 37 + F.floor(F.col("id") / 100)) % 100).cast("string"), "0123456789", "abcdefghij"),
        F.lit(" to the team"),
    )
    docs = spark.range(n).select(F.col("id").alias("doc_id"), texts.alias("text"))
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    kept = stage(spark, docs, "").filter(F.col("text").contains("welcome")).count()
    assert kept == 0
    counted = line_templates.drop_recurring_lines(docs, counts=True)
    assert counted.agg(F.sum("n_dropped")).first()[0] == n


def letters(column):
    return F.translate(column.cast("string"), "0123456789", "abcdefghij")


@pytest.mark.parametrize("n", [150, 4000])
def test_families_of_one_leaf_all_go(spark, n):
    """Fifteen templates of one length with the same first tokens; none has a tenth of the leaf."""
    own = [F.concat(F.lit(f"k{c}"), letters(F.col("id") % 15)) for c in "uvw"]
    line = F.concat_ws(
        " ", F.lit("in the last"), *own, F.concat(F.lit("name"), letters(F.floor(F.col("id") / 15) % 40)), F.lit("was"),
        F.concat(F.lit("city"), letters(F.floor(F.col("id") / 15) * 7 % 40)),
    )
    body = F.concat_ws(" ", *[F.concat(F.lit("w"), F.translate(F.md5(F.concat("id", F.lit(f"-{k}"))), "0123456789", "ghijklmnop")) for k in range(6)])
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(body, F.lit("\n"), line).alias("text"))
    found = line_templates.drop_recurring_lines(docs, counts=True)
    assert found.filter(F.col("n_dropped") != 1).count() == 0
    assert found.filter(F.col("text").contains("in the last")).count() == 0


def test_copies_do_not_shield_boilerplate(spark):
    footer = "This text is part of the public collection"

    def body(k):
        return ". ".join(prose(10 * k + j, 12) for j in range(5))

    rows = [(k, body(k) + "\n" + footer) for k in range(20)] + [(100 + k, body(90) + "\n" + footer) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_templates.drop_recurring_lines(docs).collect()
    assert not any(footer in r.text for r in found) and all(len(r.text.split()) == 60 for r in found)


def test_line_templates_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    plan = line_templates.drop_recurring_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hidden_markov_base_and_forward(spark, docs, rows):
    found = hidden_markov.score_documents(docs, top_words=64, rounds=1).collect()
    counts, held = Counter(), []
    for k, t, *_ in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        held.append(k is not None and zlib.crc32(str(k).encode()) % 7 == 2)
        if not held[-1]:
            counts.update(tokens)
    n, v = sum(counts.values()), len(counts)
    for r in found:
        if r.doc_id is None:
            continue
        tokens = [*(one_each(rows)[r.doc_id]).encode().lower().split(), None]
        assert r.n_tokens == len(tokens) and r.train_tokens == n
        assert r.n_known == sum(counts[t] > 0 for t in tokens)
        assert abs(r.base_score - sum(log10((counts[t] + 1) / (n + v + 1)) for t in tokens)) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_scaled_forward_equals_sum_over_paths():
    draw = np.random.default_rng(0)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    chain = hidden_markov.Chain(
        norm(draw.random(3)), norm(draw.random(3)), norm(draw.random((3, 3))), norm(draw.random((3, 5)))
    )
    sequences = [draw.integers(0, 5, n) for n in (1, 4, 2, 6, 6)]
    for sequence, score in zip(sequences, chain.scores(sequences)):
        paths = {(s,): chain.start[s] * chain.emits[s, sequence[0]] for s in range(3)}
        for word in sequence[1:]:
            paths = {(*p, s): x * chain.moves[p[-1], s] * chain.emits[s, word] for p, x in paths.items() for s in range(3)}
        assert abs(score - log10(sum(paths.values()))) < 1e-9


def test_baum_welch_raises_the_likelihood(spark):
    draw = np.random.default_rng(1)
    sequences = [draw.integers(0, 20, draw.integers(1, 200)) + 20 * (k % 2) for k in range(40)]
    shares = np.full(40, 1 / 40)
    chain = hidden_markov.Chain.random(2, shares)
    rows = spark.createDataFrame([(s.astype("<u2").tobytes(),) for s in sequences], "classes binary")
    before = chain.scores(sequences).sum()
    for _ in range(4):
        counts = hidden_markov.Counts(2, 40)
        counts.add(chain, sequences)
        alone = hidden_markov.Chain.from_counts(counts, shares)
        chain = hidden_markov.baum_welch(rows.repartition(4), chain, shares, parts=2)
        assert np.allclose(chain.emits, alone.emits, atol=1e-5) and np.allclose(chain.moves, alone.moves, atol=1e-5)
    assert chain.scores(sequences).sum() > before
    assert abs(counts.emits.sum() - sum(map(len, sequences))) < 1e-6


def test_markov_start_learns_from_all_documents(spark):
    """However many tokens the corpus has, no training document is left out of the first pass."""
    draw = np.random.default_rng(2)
    sequences = [draw.integers(0, 20, draw.integers(20, 100)) + 20 * (k % 2) for k in range(30)]
    rows = spark.createDataFrame(
        [(k, k, s.astype("<u2").tobytes()) for k, s in enumerate(sequences)], "key long, doc_id long, classes binary"
    )
    shares, vocabulary = np.full(40, 1 / 40), hidden_markov.Vocabulary([(k, 1 << 40) for k in range(40)], {}, 0)
    start = hidden_markov._start_chain(rows, vocabulary, shares, 2)
    before = hidden_markov.Chain.random(2, shares).scores(sequences).sum()
    assert start.scores(sequences).sum() > before + 0.2 * sum(map(len, sequences))


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    odd = [(50_000 + k, t, None, None, 0) for k, t in enumerate(
        ["don't. it's, 'll.", "İ, ΟΔΟΣ. é. ½. 三,", "<|endoftext|>. a", "ȧ, b.́ c", "x.y,z.. a1. 1,", "ª. ʰ, ⅷ."]
    )]
    found = packing.pack(docs.unionByName(table(docs.sparkSession, odd)), window=512, open_windows=4).collect()
    ids = {}
    for k, t in {**one_each(rows), **{r[0]: r[1] for r in odd}}.items():
        ids[k] = [*plain.encode(t, add_special_tokens=False).ids, 2]
    starts = defaultdict(list)
    windows = defaultdict(list)
    for r in found:
        windows[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert len(part) == r.length and len(ids[r.doc_id]) == r.doc_tokens
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
            starts[r.doc_id].append((r.start, r.length))
    copies = Counter(r[0] for r in rows)
    for k, spans in starts.items():
        assert sum(n for _, n in spans) == len(ids[k]) * copies.get(k, 1)
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 512
    used = [sum(n for _, n in s) for s in windows.values()]
    assert sum(u for u in used) / (512 * len(used)) > 0.85


def test_packing_takes_words_of_letters_and_signs_straight_to_the_model():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    words = packing.WordIds(packing.default_tokenizer())
    straight = ["Thentien", "été", "ÉTÉ!!", "Straße,", "a.***", "x", "ENDS.", "ÀÖØöøÿ&&&", "b<|", "the"]
    others = ["it's", "'s", "a'", "1a", "a1.", "x,y", "µm", "ª", "e\u0301t\u0301", "Ã©", "ﬁne", "ŐŰ", "слово.", "(a)", "<|endoftext|>", "a<|endoftext|>", "ΣΑΣ"]
    text = " ".join([*straight, *others, *straight])
    whole = plain.encode(text, add_special_tokens=False).ids
    assert words.of([text, None, ""]) == [np.array(whole, "<u4").tobytes(), b"", b""]

    words = packing.WordIds(packing.default_tokenizer())
    asked = []
    words.encode = lambda some, **_: asked.extend(some) or []
    words.of([" ".join(straight)])
    assert not asked


def test_packing_leaves_other_tokenizers_to_themselves(tmp_path):
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    joined = Tokenizer.from_file(packing.default_tokenizer())
    joined.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    added = Tokenizer.from_file(packing.default_tokenizer())
    added.add_tokens([AddedToken("the", normalized=False)])
    for tokenizer in (joined, added):
        assert packing.plain_signs(tokenizer) is None
    added.save(str(tmp_path / "added.json"))
    ids = added.encode("breathe", add_special_tokens=False).ids
    assert packing.WordIds(str(tmp_path / "added.json")).of(["breathe"]) == [np.array(ids, "<u4").tobytes()]


def test_packing_keeps_the_ids_of_separator_characters(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = [f"abc{c}def ghi,{c} {c}x.{c}\n{c}{c}." for c in spaces] + ["\x1c", "\x1f\x1e \x1d.", "a.\x1c b,\x1d\u2028c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in packing.pack(docs).collect()}
    for k, text in enumerate(texts):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert (found[k].length, found[k].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), ascii(text)


def test_personal_data_against_plain_patterns(spark):
    texts = [
        "a@b.co, x.y+z@sub.example.org. 10.0.0.1 999.1.1.1 1.2.3.4.5", "+1 (988) 555-2485 and 4041894974608795",
        "4041 8949 7460 8795 then 12", "é a@é.com b@c-d.e", None, "", "+12", "1.1.1.0000255 1.1.1.256",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal_data.personal_data(docs).collect():
        text, spans = texts[r.doc_id] or "", []
        for kind, pattern in personal_data.PATTERNS.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m.group())
                ok = {
                    "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 14 <= len(digits) <= 19 and personal_data.luhn(digits), "phone": 10 <= len(digits) <= 15,
                }[kind]
                if ok:
                    spans.append((m.start(), list(personal_data.PATTERNS).index(kind), kind, m.end()))
        want = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in personal_data.KINDS]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("text,kind,shown", [
    ("write to john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("ann at example dot org", "email", "ann at example dot org"),
    ("ｊoe＠example.com", "email", "ｊoe＠example.com"),
    ("pаul@mail.org", "email", "pаul@mail.org"),
    ("call plus one four one five five five five two six seven one!", "phone",
     "plus one four one five five five five two six seven one"),
    ("ip one nine two dot one six eight dot one dot two five", "ip", "one nine two dot one six eight dot one dot two five"),
    ("+1 (⁠415) 555‑2671", "phone", "+1 (⁠415) 555‑2671"),
])
def test_disguises_map_back_to_the_source(text, kind, shown):
    base, added = personal_data.find_spans(text)
    assert (kind, shown) in [(k, text[a:b]) for a, k, b in added]
    assert personal_data.mask(text, [s for s in added if s[1] == kind]) == text.replace(shown, f"<{kind}>")


@pytest.mark.parametrize("text,kind,shown", [
    ("write to bob at example.com", "email", "bob at example.com"),
    ("BOB AT EXAMPLE.COM", "email", "BOB AT EXAMPLE.COM"),
    ("bob (at) example.com", "email", "bob (at) example.com"),
    ("bob@example dot com", "email", "bob@example dot com"),
    ("bob@example [po\u0130nt] com", "email", "bob@example [po\u0130nt] com"),
    ("plus 1 five 5 five 1 two 3 four 5 six 7", "phone", "plus 1 five 5 five 1 two 3 four 5 six 7"),
    ("_plus one 4155552 seven 1_", "phone", "plus one 4155552 seven 1"),
    ("10 point two dot 3 dot four", "ip", "10 point two dot 3 dot four"),
])
def test_a_disguise_is_found_alone_and_beside_others(text, kind, shown):
    for around in ("{}", "{} . and one dot two", "[at] {}"):
        whole = around.format(text)
        assert (kind, shown) in [(k, whole[a:b]) for a, k, b in personal_data.find_spans(whole)[1]], around


def test_gates_pass_whatever_a_transducer_changes(monkeypatch):
    draw = random.Random(5)
    parts = ["one", "Two", "7", "41", "plus", "dot", "point", "at", "AT", "@", ".", ",", "-", "_", "bob", "x.org", "[at]", "( dot )", "\n"]
    reached = []
    monkeypatch.setattr(personal_data, "Mapped", lambda text, kind=personal_data.Mapped: reached.append(text) or kind(text))
    for _ in range(5000):
        text = "".join(draw.choice(parts) + draw.choice(["", " ", " "]) for _ in range(draw.randrange(1, 9)))
        edits = [f(text) for f in (personal_data._characters, personal_data._brackets, personal_data._plain_addresses, personal_data._digit_runs)]
        reached.clear()
        personal_data.disguised(text)
        assert reached or not any(edits), text


def test_prose_has_no_disguise():
    for k in range(30):
        assert personal_data.find_spans(prose(k, 200) + " at the end of one two dot line") == ([], [])


def test_classifier_on_held_out_rows(spark):
    draw = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        good = draw.random() < 0.7
        text = prose(k, 50, 3000) if good else " ".join(w + draw.choice(["!!", "%%%", " |"]) for w in prose(k, 50, 3000).split())
        rows.append((k, text))
        labels.append((k, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = quality_classifier.quality_scores(docs, model).collect()
    test = [r for r in found if r.held_out]
    assert {r.doc_id for r in test} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r.predicted == labels[r.doc_id][1] for r in test) / len(test) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)


def test_languages_on_held_out_rows(spark):
    stock = {
        "en": "the of and to in that with which there would people", "de": "der die und nicht auch werden für über schön",
        "nl": "het een van niet ook worden voor zijn mooi groot", "fr": "le la les des être avec pour où très déjà",
        "es": "el los las con para está niño también muy donde", "xx": "qzk zzq kqz qqk zkz",
    }
    draw, rows = random.Random(4), []
    for k in range(480):
        lang = list(stock)[k % 6]
        words = stock[lang].split()
        rows.append((k, " ".join(draw.choice(words) for _ in range(20)), lang))
    rows += [(1000, None, "en"), (1001, "12 ... 34", "en"), (1002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.languages(docs, language.fit(docs)).collect()}
    test = [r for r in rows if found[r[0]].held_out and r[0] < 1000]
    assert sum(found[k].lang_pred == lang for k, _, lang in test) / len(test) > 0.98
    assert all(found[k].lang_pred == "und" for k in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in found.values())


def test_components_of_paths_and_stars(spark):
    from logweir.llm.components import connected_components

    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(500, 501), (7, 7)]
    draw = random.Random(0)
    draw.shuffle(edges)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and all(found[k] == 100 for k in range(100, 140))
    assert found[501] == 500 and len(found) == 41 + 40 + 2


@pytest.mark.parametrize("text,most", [
    ("a" * 10**6 + " write to x@y.z", 1), ("(at)" + " " * 10**6 + "x@y.z", 1), ("a dot " * 170_000, 0), ("one " * 250_000, 0),
    ("1." * 500_000, 125_000), ("( " * 300_000 + "at )", 0), ("a@" * 500_000, 0), ("+1" + "(" * 10**6, 0), ("9" * 10**6 + " (at) ", 0),
])
def test_long_runs_take_linear_time(text, most):
    import time

    start = time.process_time()
    base, added = personal_data.find_spans(text)
    assert len(base) + len(added) <= most and time.process_time() - start < 20


def test_identifiers_equal_the_patterns():
    draw = random.Random(1)
    for _ in range(5000):
        text = "".join(draw.choice("ab1.9_@@-+ %()7") for _ in range(draw.randint(0, 40)))
        want = [
            (m.start(), kind, m.end()) for kind in personal_data.KINDS
            for m in personal_data.PATTERNS[kind].finditer(text) if personal_data._holds(kind, m.group())
        ]
        assert personal_data.identifiers(text) == want


def test_spans_are_taken_once_whatever_lies_between():
    base = [(k, "ip", k + 2) for k in range(10, 60, 2)]
    assert personal_data._apart([(0, "email", 200)], base) == []
    assert personal_data._apart([(0, "ip", 200), (100, "ip", 120)], base) == [(0, "ip", 200)]
    assert personal_data._apart([(0, "email", 10), (60, "phone", 70)], base) == [(0, "email", 10), (60, "phone", 70)]


def test_all_of_many_languages_are_learned(spark):
    rows = []
    for k in range(300):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(40)]
        draw = random.Random(k)
        rows += [(k * 10 + j, " ".join(draw.choice(letters) for _ in range(30)), f"l{k:03d}") for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.families) == 300
    right = sum(model.predict(t)[0] == lang for _, t, lang in rows)
    assert right > 0.97 * len(rows) and len({model.predict(t)[0] for _, t, _ in rows}) == 300


def test_decontamination_in_blocks_equals_one_pass(spark, docs):
    passages = [(k, prose(seed, 70)) for k, seed in enumerate((999, 2, 4, 1))] + [(7, "one"), (8, None)]
    items = spark.createDataFrame(passages, "item_id long, text string")
    odd = docs.withColumn("_hits", F.lit("x")).withColumn("row", F.lit(1))
    want = sorted(map(str, decontaminate.decontaminate(odd, items, max_coverage=0.5).collect()))
    assert want == sorted(map(str, decontaminate.decontaminate(odd, items, max_coverage=0.5, block_words=20).collect()))
    assert len(want) < docs.count()


def test_repetitive_items_take_linear_time():
    import time

    item = [b"same"] * 20_000
    start = time.process_time()
    model = decontaminate.Automaton([("a", item)])
    found, held = model.hits(item)
    assert len(found) == 20_000 - 9 and held == {0} and time.process_time() - start < 20


def test_one_row_stays_of_repeated_rows(spark):
    text, other = prose(31, 80), prose(32, 80)
    rows = [(1, text, "en", "a", 0), (1, text, "en", "a", 0), (2, text, "en", "a", 0), (None, text, "en", "a", 0)] * 2
    rows += [(5, other, "en", "a", 0), (5, other + " more", "en", "b", 0), (None, prose(33, 50), None, None, 0)] * 2
    rows += [(None, None, None, None, 0), (None, " ", None, None, 0), (9, None, "en", "a", 0)]
    found = minhash.deduplicate(table(spark, rows)).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in found) == sorted(
        [(1, text[:9]), (5, other[:9]), (0, prose(33, 50)[:9]), (0, ""), (0, " "), (9, "")]
    )
    again = minhash.deduplicate(table(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def plain_dual(rows, target, size, cost, steps=60_000):
    """The hinge-loss dual by projected gradient on the full kernel matrix."""
    x = np.zeros((len(rows), size + 1))
    for k, (index, value) in enumerate(rows):
        x[k, index], x[k, size] = value, 1
    kernel = (x @ x.T) * np.outer(target, target)
    dual, rate = np.zeros(len(rows)), 1 / np.linalg.eigvalsh(kernel)[-1]
    for _ in range(steps):
        dual = np.clip(dual - rate * (kernel @ dual - 1), 0, cost)
    return (dual * target) @ x


def primal(weights, rows, target, cost):
    margins = np.array([t * (weights[i] @ v + weights[-1]) for (i, v), t in zip(rows, target)])
    return 0.5 * weights @ weights + (cost * np.maximum(0, 1 - margins)).sum()


def test_hinge_model_solves_the_dual():
    draw = np.random.default_rng(2)
    rows = []
    for _ in range(50):
        index = np.sort(draw.choice(12, 4, replace=False))
        rows.append((index, draw.normal(size=4)))
    target = np.where(draw.random(50) < 0.5, 1.0, -1.0)
    cost = draw.uniform(0.2, 1.0, 50)
    got = linear.hinge_model(rows, target, 12, cost, epochs=3000)
    want = plain_dual(rows, target, 12, cost)
    assert primal(got, rows, target, cost) <= primal(want, rows, target, cost) * 1.001 + 1e-6
    assert np.abs(got - want).max() < 0.02


def test_quality_features_are_scaled_by_log_count_ratios(monkeypatch):
    """The weights are those of a hinge model on indicators times the ratio, folded back onto the indicators."""
    draw = random.Random(6)
    rows = [np.array(sorted(draw.sample(range(30), 6))) for _ in range(40)]
    good = np.array([5 in r or draw.random() < 0.3 for r in rows])
    seen = {}
    solve = quality_classifier.hinge_model
    monkeypatch.setattr(quality_classifier, "BITS", 5)
    monkeypatch.setattr(
        quality_classifier, "hinge_model", lambda r, t, size, cost: seen.update(rows=r, target=t) or solve(r, t, size, cost)
    )
    model = quality_classifier.fit_rows(rows, good, 0.5)
    learn = [k for k in range(40) if k % 4 != 3]
    count = {y: np.array([1 + sum(j in rows[k] for k in learn if good[k] == y) for j in range(32)], float) for y in (True, False)}
    ratio = np.log(count[True] / count[True].sum()) - np.log(count[False] / count[False].sum())
    for (index, value), k in zip(seen["rows"], learn):
        assert (index == rows[k]).all() and np.allclose(value, ratio[rows[k]] / np.sqrt(len(rows[k])))
    assert (seen["target"] == np.where(good[learn], 1, -1)).all()
    margin = model.margin(rows[0])
    assert margin == pytest.approx(float(model.weights[rows[0]].sum() / np.sqrt(6) + model.offset), rel=1e-6)


def test_pair_votes_decide_inside_a_family():
    """The predicted language wins most of the pair models of the best family; plain numpy gives the same."""
    draw = np.random.default_rng(5)
    names, size = ["de", "en", "nl"], (1 << language.BITS) + 1
    rows = [("*", "germanic", "", draw.normal(size=size)), ("*", "romance", "", draw.normal(size=size))]
    rows += [("germanic", a, b, draw.normal(size=size)) for a, b in (("de", "en"), ("de", "nl"), ("en", "nl"))]
    rows.append(("romance", "fr", "", None))
    model = language.Model([(g, a, b, w.astype("<f4").tobytes() if w is not None else b"") for g, a, b, w in rows])
    for k in range(60):
        text = prose(k, 30)
        slots, values = language.features(text)
        dot = lambda w: float(w.astype("<f4")[slots] @ values + w.astype("<f4")[-1])
        family = max(("germanic", "romance"), key=lambda f: dot(next(w for g, a, _, w in rows if g == "*" and a == f)))
        want = "fr"
        if family == "germanic":
            wins, sums = Counter(), Counter()
            for _, a, b, w in rows[2:5]:
                wins[a if dot(w) > 0 else b] += 1
                sums[a] += dot(w)
                sums[b] -= dot(w)
            want = max(names, key=lambda n: (wins[n], sums[n]))
        assert model.predict(text)[0] == want
