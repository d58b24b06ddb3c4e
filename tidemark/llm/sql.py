"""SQL (DuckDB) for the operators' results, over whole tables."""

from __future__ import annotations

import string

from . import quality_rules as Q

_AZ = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w ELSE [w[i], w[i + 1]] END AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w), 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_CONTROL = r"([\[<])(\\*)(/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|SEP\])"


def _escaped(x: str) -> str:
    return rf"regexp_replace({x}, '{_CONTROL}', '\1\2\\\3', 'g')"


OP3 = f"""
WITH m AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM m),
f AS (SELECT *, length({_escaped('text')}) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 20 + length({_escaped('role')}) END AS size FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, (3 + sum(size))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

OP5 = f"""
WITH it AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM it, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM}) AS w FROM documents),
g AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM d, (SELECT DISTINCT m FROM p), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i) WHERE len(w) >= m),
h AS (SELECT doc_id, g.m, i, item_id FROM g JOIN p ON p.m = g.m AND p.g = g.g),
x AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS q FROM h) GROUP BY 1),
y AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS k FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_hit, coalesce(y.n, 0)::BIGINT AS n_items, sha256(coalesce(y.k, '')) AS items_sha256, x.n IS NOT NULL AS contaminated
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i) WHERE len(w) >= 35),
r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
q AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN r ON g.g = r.g),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
s AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS kept FROM k ANTI JOIN q ON k.doc_id = q.doc_id AND k.p = q.p GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (new) AS spans FROM (SELECT *, p - lag(p, 1, -9) OVER (PARTITION BY doc_id ORDER BY p) > 1 AS new FROM q) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, coalesce(n.spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_COUNT = {k: f"len(regexp_extract_all(t, {_quoted(p)}))" for k, p in Q.CLASSES.items()}


def _jsd(p: str, q: str) -> str:
    """Distance of two lists of counts."""
    a, b = f"(x[1] / list_sum({p}))", f"(x[2] / list_sum({q}))"
    term = lambda s, t: f"(CASE WHEN {s} > 0 THEN {s} * log2(2 * {s} / ({s} + {t})) ELSE 0e0 END)"
    return f"sqrt(greatest(0e0, list_sum(list_transform(list_zip({p}, {q}), lambda x: ({term(a, b)} + {term(b, a)}) / 2))))"


def _fence(name: str, times: float, every: bool = False) -> str:
    low, mid = (f"quantile_cont(round({name}, 3), {p}) FILTER (NOT base_failed)" for p in (0.1, 0.5))
    n, way = f"count({name}) FILTER (NOT base_failed)", f"{times} * greatest({mid} - {low}, {Q.LEAST_WAY})"
    return f"{mid} + {way} * (1 + {Q.MIN_GROUP} / {n})" if every else f"CASE WHEN {n} >= {Q.MIN_GROUP} THEN {mid} + {way} END"


_FENCES = f"{_fence('cd', Q.CHAR_FENCE)} AS c, {_fence('wd', Q.WORD_FENCE)} AS w"

OP8 = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
long AS (SELECT lang, list_distinct(w) AS u FROM d WHERE len(w) >= {Q.MIN_WORDS} AND lang IS NOT NULL),
known AS (SELECT lang FROM long GROUP BY 1 HAVING count(*) * {Q.LANGUAGE_PARTS} > (SELECT count(*) FROM long)),
wc AS (SELECT lang, word, count(*) AS c FROM (SELECT lang, unnest(u) AS word FROM long SEMI JOIN known USING (lang)) WHERE length(word) <= {Q.MAX_COMMON_CHARS} GROUP BY 1, 2),
wr AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY c DESC, word) AS r FROM wc QUALIFY r <= {Q.N_COMMON}),
ranks AS (SELECT unnest(range(1, {Q.N_COMMON} + 1)) AS r),
hc AS (SELECT doc_id, r, count(*) AS c FROM (SELECT doc_id, lang, unnest(w) AS word FROM d) JOIN wr USING (lang, word) GROUP BY 1, 2),
hw AS (SELECT d.doc_id, list(coalesce(hc.c, 0)::DOUBLE ORDER BY ranks.r) AS held, sum(coalesce(hc.c, 0)) AS common FROM d SEMI JOIN known USING (lang) CROSS JOIN ranks LEFT JOIN hc ON hc.doc_id = d.doc_id AND hc.r = ranks.r GROUP BY 1),
g AS (SELECT doc_id, i, w[i : i + 2] AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) WHERE len(w) >= 3),
r AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest(range(i, i + 3)) AS p FROM g SEMI JOIN r ON g.doc_id = r.doc_id AND g.g = r.g) GROUP BY 1),
m AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, list_sum(list_transform([0] || list_transform(w, lambda x: length(x)), lambda x: x))::BIGINT AS word_chars, length(t)::BIGINT AS n_chars,
  {', '.join(f'{v}::BIGINT AS n_{k}' for k, v in _COUNT.items())}, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_SPACED}))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_SPACED})))))::BIGINT AS n_dup_lines,
  list_append(held, len(w)::DOUBLE - common) AS word_hist FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN hw ON hw.doc_id = d.doc_id),
h AS (SELECT *, [(n_chars - word_chars)::DOUBLE, {', '.join(f'n_{k}::DOUBLE' for k in Q.CLASSES)}, (word_chars - {' - '.join(f'n_{k}' for k in Q.CLASSES)})::DOUBLE] AS char_hist,
  n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
f AS (SELECT lang, [{', '.join(f'sum(char_hist[{i}])' for i in range(1, len(Q.CLASSES) + 3))}] AS char_ref, [{', '.join(f'sum(word_hist[{i}])' for i in range(1, Q.N_COMMON + 2))}] AS word_ref FROM h WHERE NOT base_failed GROUP BY 1),
j AS (SELECT h.*, length(bin(n_words)) AS size, CASE WHEN n_chars >= {Q.MIN_CHARS} AND char_ref IS NOT NULL THEN {_jsd('char_hist', 'char_ref')} END AS cd,
  CASE WHEN n_words >= {Q.MIN_WORDS} AND word_hist IS NOT NULL AND word_ref IS NOT NULL THEN {_jsd('word_hist', 'word_ref')} END AS wd FROM h LEFT JOIN f ON h.lang IS NOT DISTINCT FROM f.lang),
a AS (SELECT lang, size, {_FENCES} FROM j GROUP BY 1, 2),
b AS (SELECT lang, {_FENCES} FROM j GROUP BY 1),
e AS (SELECT {_fence('cd', Q.CHAR_FENCE, True)} AS c, {_fence('wd', Q.WORD_FENCE, True)} AS w FROM j)
SELECT doc_id, n_words, word_chars, n_symbol AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd, 0) <= least({Q.MAX_CHAR_DISTANCE}, coalesce(a.c, b.c, e.c)) + 1e-9 AND coalesce(wd, 0) <= least({Q.MAX_WORD_DISTANCE}, coalesce(a.w, b.w, e.w)) + 1e-9 AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance
FROM j JOIN a ON j.lang IS NOT DISTINCT FROM a.lang AND j.size = a.size JOIN b ON j.lang IS NOT DISTINCT FROM b.lang CROSS JOIN e
"""

_LETTERS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"

OP13 = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_LETTERS}) AS w FROM documents),
o AS (SELECT lang, source, doc, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS whole FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) + 5 * count(*) AS own, sum(whole) + 5 * count(*) AS lang_own FROM m GROUP BY 1, 2),
p AS (SELECT m.*, 1 + 1000000000::HUGEINT * (n + 5) // own AS p, 1 + 1000000000::HUGEINT * (whole + 5) // lang_own AS q FROM m JOIN t USING (lang, source)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 50
"""

_INK = r"[^\x20\x09-\x0D]"


def _cheapest(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _with(way: str, cost: str, letter: str) -> str:
    """A way, (ten digits of cost, audit) as one string, with an edit more."""
    return f"(lpad((left({way}, 10)::INTEGER + {cost})::VARCHAR, 10, '0') || substr({way}, 11) || '{letter}')"


def _step(place: int) -> str:
    """The cheapest way to a place in the grammar by the next row, without insertions."""
    ways = [f"{_with(f"s{place}", "3", "D")}"]
    if place in (1, 2, 3):
        sources = {1: [(0, "s")], 2: [(0, "u"), (1, "u"), (3, "u")], 3: [(2, "a")]}[place]
        for k, initial in sources:
            ways.append(f"CASE WHEN f NOT IN (1, 2) AND c = '{initial}' THEN {_with(f's{k}', '(f = 3)::INTEGER', 'K')} END")
            if place > 1:
                ways.append(f"CASE WHEN f NOT IN (1, 2) AND c <> '{initial}' THEN {_with(f's{k}', '2 + (f = 3)::INTEGER', 'R')} END")
    return _cheapest(*ways, "NULL")


_INSERTED = [_cheapest("x2", *(_with(f"x{k}", "2", "I") for k in (0, 1, 3))), _cheapest("x3", _with(_cheapest("x2", *(_with(f"x{k}", "2", "I") for k in (0, 1, 3))), "2", "I"))]

OP11 = rf"""
WITH RECURSIVE bit AS (SELECT range AS b, range AS v, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bit WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS tab FROM bit WHERE k = 8),
z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT z.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)), lambda r, x: xor(r >> 8, tab[(xor(r, x) & 255) + 1]))) % 20 AS k FROM z, crc),
dm AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE k <> 0),
n AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ink, left(role, 1) AS c FROM dm WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
q AS (SELECT conv_id, turn, role, text, i, c, CASE WHEN ink = '' THEN 1 WHEN again > 1 THEN 2 WHEN right(ink, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS f, lead(c) OVER (PARTITION BY conv_id ORDER BY i) AS nc FROM n),
st AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (nc IS NOT NULL AND c || nc NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY 1),
w AS (SELECT conv_id, 0::BIGINT AS i, '0000000000' AS s0, NULL::VARCHAR AS s1, '0000000002I' AS s2, '0000000004II' AS s3 FROM st
  UNION ALL SELECT conv_id, i, x0, x1, {_INSERTED[0]}, {_INSERTED[1]} FROM (SELECT w.conv_id, q.i, {', '.join(f'{_step(k)} AS x{k}' for k in range(4))} FROM w JOIN q ON q.conv_id IS NOT DISTINCT FROM w.conv_id AND q.i = w.i + 1)),
e AS (SELECT st.conv_id, least(s0, s3)[:10]::BIGINT AS cost, least(s0, s3)[11:] AS audit FROM st JOIN w ON w.conv_id IS NOT DISTINCT FROM st.conv_id AND w.i = st.rows),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS a, unnest(range(1, length(audit) + 1)) AS p FROM e WHERE audit <> ''),
lr AS (SELECT *, count(*) FILTER (a <> 'I') OVER o AS i, count(*) FILTER (a <> 'D') OVER o AS m FROM l WINDOW o AS (PARTITION BY conv_id ORDER BY p)),
lq AS (SELECT lr.*, q.role, q.text, max((a = 'K' AND m = 1 AND q.c = 's')::INTEGER) OVER (PARTITION BY lr.conv_id) AS lead_s FROM lr LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM lr.conv_id AND q.i = lr.i AND lr.a <> 'I'),
t AS (SELECT conv_id, string_agg(CASE WHEN a = 'K' THEN role WHEN (m - lead_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS body FROM lq WHERE a <> 'D' GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLE_SQL = {"op1_minhash_near_dedup": OP1, "op3_chat_format": OP3, "op5_decontamination": OP5, "op8_quality_rules": OP8, "op9_recompression": OP9, "op11_structure_repair": OP11, "op13_source_divergence": OP13}
