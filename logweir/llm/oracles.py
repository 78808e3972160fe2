"""DuckDB SQL with the rows of the operators' queries."""

from __future__ import annotations

from logweir.llm import collocations as phrases, decontaminate, fill_in_middle as middle, line_templates, quality_rules as rules

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def gram(width: int, order: str = "o") -> str:
    parts = ["word", *(f"lead(word, {k}) OVER {order}" for k in range(1, width))]
    return " || ' ' || ".join(parts)


def _quality_rules() -> str:
    widths = sorted({rules.BASE_WINDOW, *rules.NGRAM_LIMITS})
    grams = ", ".join(f"{gram(n)} AS g{n}" for n in widths)
    again = ", ".join(
        f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS r{n}" for n in widths
    )
    inside = ", ".join(
        f"bool_or(r{n}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING "
        f"AND CURRENT ROW) AS c{n}" for n in widths
    )
    sums = ", ".join(
        f"coalesce(sum(length(word)) FILTER (c{n}), 0)::BIGINT AS dup_chars_{n}"
        for n in rules.NGRAM_LIMITS
    )
    columns = ", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in rules.NGRAM_LIMITS)
    verdict = " AND ".join(
        f"100 * dup_chars_{n} <= {most} * word_chars" for n, most in rules.NGRAM_LIMITS.items()
    )
    base = rules.BASE_WINDOW
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
lists AS (SELECT doc_id, body, regexp_extract_all(body, {WORDS}) AS ws FROM docs),
places AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM lists),
grams AS (SELECT *, {grams} FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT *, {again} FROM grams),
marks AS (SELECT *, {inside} FROM twice),
counts AS (
  SELECT doc_id, {sums}, count(*) FILTER (c{base}) AS n_repeat_words FROM marks GROUP BY doc_id
),
split AS (
  SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS nth
  FROM (SELECT doc_id, string_split(body, chr(10)) AS s FROM docs)
),
lines AS (
  SELECT *, len(array_to_string(regexp_extract_all(line, {WORDS}), '')) AS chars,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY nth) > 1 AS dup
  FROM split WHERE regexp_matches(line, {WORDS})
),
line_counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines,
    coalesce(sum(chars) FILTER (dup), 0)::BIGINT AS dup_line_chars FROM lines GROUP BY doc_id
),
joined AS (
  SELECT l.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, {columns}
  FROM lists l LEFT JOIN counts USING (doc_id) LEFT JOIN line_counts USING (doc_id)
),
judged AS (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.BASE_LIMIT} * n_words AS base_failed
  FROM joined
)
SELECT *, NOT base_failed AND 100 * n_dup_lines <= {rules.LINE_LIMIT} * n_lines
  AND 100 * dup_line_chars <= {rules.LINE_CHAR_LIMIT} * word_chars AND {verdict} AS kept
FROM judged
"""


def _decontaminate() -> str:
    n = decontaminate.WINDOW
    pattern = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

    def sequences(name: str, source: str, key: str) -> str:
        body = LOWER.format("coalesce(text, '')")
        return f"""{name}_lists AS (SELECT {key}, regexp_extract_all({body}, {pattern}) AS ws FROM {source}),
{name} AS (SELECT {key}, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM {name}_lists)"""

    def grams(name: str, key: str, keep) -> str:
        return " UNION ALL ".join(
            f"SELECT * FROM (SELECT {key}, pos, n, {m} AS width, {gram(m, f'(PARTITION BY {key} ORDER BY pos)')}"
            f" AS g FROM {name}) WHERE g IS NOT NULL{keep(m)}" for m in range(1, n + 1)
        )

    return f"""
WITH {sequences('item', 'benchmark', 'item_id')},
{sequences('doc', 'documents', 'doc_id')},
windows AS (SELECT DISTINCT item_id, width, g FROM (
  {grams('item', 'item_id', lambda m: f' AND width = least(n, {n})')})),
doc_grams AS (
  {grams('doc', 'doc_id', lambda m: f' AND {m} IN (SELECT width FROM windows)')}
),
hits AS (SELECT doc_id, pos, d.width, item_id FROM doc_grams d JOIN windows USING (width, g)),
hit_words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(pos, pos + width - 1)) AS place FROM hits) GROUP BY doc_id
),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_lists LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _line_templates() -> str:
    least, lead = line_templates.MIN_DOCS, line_templates.LEADING
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, text, string_split(text, chr(10)) AS parts,
    string_split(regexp_replace(text, '[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*', '<*>', 'g'), chr(10)) AS masked
  FROM documents
),
classes AS (
  SELECT row, coalesce(list_min(list_transform(list_filter(string_split_regex(text, '[.,;:!?\n]'),
    lambda x: length(x) >= {line_templates.PIECE_CHARS}), lambda x: md5(x))), md5(text)) AS class FROM docs
),
lines AS (
  SELECT row, unnest(masked) AS body, generate_subscripts(masked, 1) AS line FROM docs
),
split AS (
  SELECT row, line, regexp_extract_all(body, {WORDS}) AS tokens FROM lines
),
leaves AS (
  SELECT *, len(tokens) AS size, len(tokens) || ' ' || array_to_string(tokens[1:{lead}], ' ') AS leaf
  FROM split WHERE len(tokens) >= {line_templates.MIN_TOKENS}
),
places AS (
  SELECT leaf, size, row, line, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM leaves
),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY leaf, place, token) AS n FROM places WHERE token <> '<*>'
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row, line ORDER BY n DESC, place) AS rank FROM counted WHERE n >= {least}
),
templates AS (
  SELECT leaf, row, line, string_agg(place || ' ' || token, ' ' ORDER BY place) FILTER (2 * rank <= size + 1) AS template
  FROM ranked GROUP BY leaf, row, line, size HAVING 2 * count(*) >= size
),
recurring AS (
  SELECT leaf, template FROM templates JOIN classes USING (row) JOIN docs USING (row) GROUP BY ALL
  HAVING count(DISTINCT text) >= {least} AND 2 * count(DISTINCT class) >= count(DISTINCT text)
),
cut AS (SELECT row, line FROM templates SEMI JOIN recurring USING (leaf, template)),
originals AS (
  SELECT row, unnest(parts) AS body, generate_subscripts(parts, 1) AS line FROM docs
),
kept AS (
  SELECT row, string_agg(body, chr(10) ORDER BY line) AS body
  FROM originals ANTI JOIN cut USING (row, line) GROUP BY row
)
SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines,
  coalesce((SELECT count(*) FROM cut WHERE cut.row = docs.row), 0)::BIGINT AS n_dropped,
  sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (row)
"""


def _minhash(width: int = 4) -> str:
    body = LOWER.format("coalesce(text, '')")
    return f"""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all({body}, {WORDS}) AS ws FROM documents
),
places AS (
  SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM lists
),
grams AS (
  SELECT doc_id, {gram(width)} AS g FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
sets AS (
  SELECT DISTINCT doc_id, g FROM grams WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM lists WHERE len(ws) BETWEEN 1 AND {width - 1}
),
sizes AS (SELECT doc_id, count(*) AS size FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both
  FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
),
pairs AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * n_both >= 80 * (p.size + q.size - n_both)
),
edges AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT node, y FROM reach JOIN edges ON seen = x
)
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept
FROM documents JOIN reach ON node = doc_id LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, size
"""


def _repeats(width: int = 13) -> str:
    return f"""
WITH lists AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents
),
places AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM lists),
grams AS (
  SELECT doc_id, pos, word, {gram(width)} AS g FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
seen AS (
  SELECT doc_id, pos, word, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM grams
),
marks AS (
  SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {width - 1} PRECEDING
    AND CURRENT ROW) AS gone FROM seen
),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed,
    string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS body FROM marks GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM lists LEFT JOIN kept USING (doc_id)
"""


def _fill_in_middle() -> str:
    hashes = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::UBIGINT AS h{k + 1}" for k in range(4))
    p, s, m = (f"'{mark}'" for mark in (middle.PREFIX, middle.SUFFIX, middle.MIDDLE))
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('{middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
),
units AS (SELECT *, regexp_extract_all(body, '[^\n]*\n|[^\n]+') AS u, {hashes} FROM docs),
cuts AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS c1,
    greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS c2 FROM units
),
parts AS (
  SELECT doc_id, n, body, array_to_string(u[1:c1], '') AS prefix, array_to_string(u[c1 + 1:c2], '') AS mid,
    array_to_string(u[c2 + 1:], '') AS suffix,
    CASE WHEN body = '' OR contains(body, {p}) OR contains(body, {s}) OR contains(body, {m}) OR h3 % 100 >= {middle.RATE}
      THEN 'plain' WHEN h4 % 100 < {middle.SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || mid
    ELSE {s} || suffix || {p} || prefix || {m} || mid END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM parts
"""


def _collocations() -> str:
    low = LOWER.format("coalesce(text, '')")
    grams = " UNION ALL ".join(
        f"SELECT lang, {m} AS words, {gram(m)} AS phrase FROM places WINDOW o AS (PARTITION BY row, piece ORDER BY pos)"
        for m in range(1, phrases.WIDTH + 1)
    )
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, {low} AS body FROM documents),
pieces AS (
  SELECT row, lang, unnest(s) AS piece_text, generate_subscripts(s, 1) AS piece
  FROM (SELECT row, lang, string_split_regex(body, '[.,;:!?\x0A-\x0D]') AS s FROM docs)
),
places AS (
  SELECT row, lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT *, regexp_extract_all(piece_text, '[^\x20\x09]+') AS w FROM pieces)
),
counts AS (
  SELECT lang, words, phrase, count(*) AS f FROM ({grams}) WHERE phrase IS NOT NULL GROUP BY ALL
  HAVING count(*) >= {phrases.MIN_COUNT}
),
sizes AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
split AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(generate_series(1, words - 1)) AS k
  FROM counts WHERE words > 1
),
cuts AS (
  SELECT s.lang, s.words, s.phrase, a, k, n, h.f AS l, t.f AS r,
    (1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS score
  FROM split s JOIN sizes USING (lang)
  JOIN counts h ON h.lang = s.lang AND h.phrase = array_to_string(w[1:k], ' ')
  JOIN counts t ON t.lang = s.lang AND t.phrase = array_to_string(w[k + 1:], ' ')
),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM weakest p WHERE NOT EXISTS (
    SELECT 1 FROM counts q WHERE q.lang = p.lang AND q.words > p.words
      AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ') AND 100 * q.f >= {phrases.INSIDE} * p.a)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {phrases.TOP}
"""


QUALITY_RULES = _quality_rules()
DECONTAMINATE = _decontaminate()
LINE_TEMPLATES = _line_templates()
MINHASH = _minhash()
REPEATS = _repeats()
COLLOCATIONS = _collocations()
FILL_IN_MIDDLE = _fill_in_middle()
