"""SQL twins of the text queries that SQL can express, for DuckDB over whole tables."""

from __future__ import annotations

from . import divergence, licenses, mixing, quality, topk, trie

_GAP = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_GAP}'), lambda x: x <> '')"


def _strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _measure(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0 END"


def quality_sql() -> str:
    bounds = " AND ".join(f"{r.measure} BETWEEN {r.low} AND {r.high}" for r in quality.RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)),
             lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM d, range(1, len(ws) - 1) r(i)),
again AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
spots AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win JOIN again USING (doc_id, k), range(3) r(j) GROUP BY doc_id),
c AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{_GAP}', '', 'g')) AS word_chars,
        length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(ws, lambda w: lower(w) IN ({_strings(quality.STOP_WORDS)}))) AS n_stop_words,
        length(t) - length(translate(t, '!?', '')) AS n_shouts, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
        len(list_filter(ls, lambda l: regexp_matches(l, '^\s*[-*•]'))) AS n_bullets,
        len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)\s*$'))) AS n_ellipses
      FROM d LEFT JOIN spots USING (doc_id)),
m AS (SELECT *, {_measure('word_chars', 'n_words')} AS mean_word_chars, {_measure('n_symbols', 'word_chars')} AS symbol_ratio,
        {_measure('n_shouts', 'word_chars')} AS shout_ratio, {_measure('n_upper', 'word_chars')} AS upper_ratio,
        {_measure('n_stop_words', 'n_words')} AS stop_word_ratio, {_measure('n_dup_lines', 'n_lines')} AS dup_line_ratio,
        {_measure('n_bullets', 'n_lines')} AS bullet_line_ratio, {_measure('n_ellipses', 'n_lines')} AS ellipsis_line_ratio,
        n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {int(100 * quality.MAX_REPEATED)} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {bounds} AS kept FROM m
"""


def licenses_sql() -> str:
    sets = {name: licenses.template_bigrams(text) for name, text in sorted(licenses.NOTICES.items())}
    rows = ", ".join(f"('{name}', [{_strings(pairs)}])" for name, pairs in sets.items())
    low, high = licenses.SIMILARITY / (2 - licenses.SIMILARITY), (2 - licenses.SIMILARITY) / licenses.SIMILARITY
    return rf"""
WITH templates AS (SELECT * FROM (VALUES {rows}) t(license, b)),
n AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS t FROM documents),
u AS (SELECT DISTINCT doc_id, unit FROM (
        SELECT doc_id, trim(unnest(string_split(t, chr(10)))) AS unit FROM n
        UNION ALL SELECT doc_id, trim(regexp_replace(unnest(string_split_regex(t, '\n ?(?:\n ?)+')), '[ \n]+', ' ', 'g')) FROM n
        UNION ALL SELECT doc_id, trim(regexp_replace(t, '[ \n]+', ' ', 'g')) FROM n)),
w AS (SELECT doc_id, unit, string_split(unit, ' ') AS ws FROM u),
p AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS a FROM w
      WHERE len(ws) BETWEEN 2 AND 2000),
s AS (SELECT doc_id, unit, license, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM p JOIN templates
        ON len(a) BETWEEN {low} * len(b) - 1e-9 AND {high} * len(b) + 1e-9),
best AS (SELECT doc_id, unit, arg_min(license, (-dice, license)) AS license, max(dice) AS dice FROM s GROUP BY doc_id, unit),
f AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT license) AS n, max(dice) AS best
      FROM best WHERE dice >= {licenses.SIMILARITY} GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(licenses, '') AS licenses, best AS best_dice FROM documents LEFT JOIN f USING (doc_id)
"""


def mixing_sql() -> str:
    weights = f"[{', '.join(map(str, mixing.WEIGHTS))}]"
    return f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, greatest(1.0::DOUBLE - 10.0::DOUBLE * coalesce(
             (length(text) - length(translate(text, '{mixing.SYMBOLS}', ''))) / nullif(length(text), 0), 0), 0.1::DOUBLE) AS quality,
             CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS draw FROM documents),
k AS (SELECT *, -ln((draw + 1)::DOUBLE / 4503599627370496) / quality AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
v AS (SELECT *, {weights}[(rank - 1) % {len(mixing.WEIGHTS)} + 1] AS w, {mixing.CAP} * source_size AS cap FROM r),
l AS (SELECT *, cap / w AS ratio, (CAST(sum(source_size) OVER () AS DOUBLE) * {mixing.SHARE}::DOUBLE
               - coalesce(sum(cap) OVER o, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
      FROM v WINDOW o AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(
        (SELECT level FROM l WHERE ratio > level ORDER BY ratio, rank LIMIT 1) * w, cap::DOUBLE)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
o AS (SELECT k.*, e.* EXCLUDE (source), target - epochs * source_size AS rest, coalesce(sum(size) OVER (
        PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN so_far < rest AND so_far + size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""


def substrings_sql(length: int = 13) -> str:
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {length - 1}], ' ') AS k FROM d, range(1, len(ws) - {length - 2}) r(i)),
first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN first USING (k), range({length}) r(j) WHERE f < doc_id),
u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM u ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def topk_sql(every: int = 50, k: int = topk.TOP, scale: int = topk.SCALE) -> str:
    return f"""
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.n AS other, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}
"""


def divergence_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    added, scale = divergence.ADDED, divergence.SCALE
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
           FROM documents),
t AS (SELECT row, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= {divergence.MIN_DOCUMENTS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + ({scale}::HUGEINT * (n + {added})) // (sum(n) OVER w + {added} * count(*) OVER w) AS p FROM f
      WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY lang, term),
q AS (SELECT lang, term, 1 + ({scale}::HUGEINT * (n + {added})) // (sum(n) OVER w + {added} * count(*) OVER w) AS q FROM l
      WINDOW w AS (PARTITION BY lang)),
m AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang
        AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value FROM g a JOIN g b
        ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
WHERE part = 'pair' OR rank <= {divergence.TERMS}
"""


def trie_sql() -> str:
    polynomial = 0xEDB88320
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * %d))" % polynomial
    codes = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits}), 4294967295)"
    return f"""
WITH h AS (SELECT conv_id, {crc} % {trie.DEEPEST} AS h, conv_id - conv_id % {trie.SPAN} AS base
           FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations),
r AS (SELECT h.conv_id, 0 AS part, i, role, text FROM h JOIN t ON t.conv_id = base AND i < h
      UNION ALL SELECT h.conv_id, 1, i, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND i >= h),
m AS (SELECT conv_id, list(struct_pack(role := role, text := text)) OVER w AS k, octet_length(encode(text)) AS bytes,
        count(*) OVER (PARTITION BY conv_id) AS n FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)
      UNION ALL SELECT conv_id, [], 0, (SELECT count(*) FROM r WHERE r.conv_id = h.conv_id) FROM h),
v AS (SELECT k, len(k) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = len(k)), '')) AS ends_sha256
      FROM m GROUP BY k),
c AS (SELECT p.k, count(*) AS n FROM v JOIN v p ON v.depth = p.depth + 1 AND v.k[:p.depth] = p.k GROUP BY p.k),
f AS (SELECT v.*, coalesce(c.n, 0) AS n_children FROM v LEFT JOIN c USING (k)),
a AS (SELECT k[:d] AS k, sum(CAST(n_children = 0 AS INTEGER)) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
      FROM f, range(0, depth + 1) s(d) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN a USING (k) LEFT JOIN f p ON f.depth = p.depth + 1 AND f.k[:p.depth] = p.k
"""
