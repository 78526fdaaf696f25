"""SQL (DuckDB) that gives the rows of corpus operators that SQL can express."""

from __future__ import annotations

from tessella.llm.quality_rules import BOILERPLATE, QualityRules
from tessella.llm.texts import WORD

_words = lambda c: f"regexp_extract_all(coalesce({c}, ''), '{WORD}')"
_low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_symbols = lambda c: f"length(regexp_replace(coalesce({c}, ''), '[^#*$%&|<>]', '', 'g'))"


def jaccard(n: int, num: int, den: int) -> str:
    gram = " || chr(10) || ".join(f"l[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE listed AS (SELECT doc_id, {_words(_low)} AS l FROM documents),
grams AS (SELECT doc_id, unnest(CASE WHEN len(l) >= {n} THEN list_distinct(list_transform(range(1, len(l) - {n} + 2), lambda i: {gram})) WHEN len(l) > 0 THEN [array_to_string(l, chr(10))] ELSE []::VARCHAR[] END) AS g FROM listed),
sizes AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN grams USING (doc_id) GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE {den} * c >= {num} * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, y FROM reach r JOIN links ON x = other)
SELECT doc_id, n AS n_shingles, min(other) AS component_id FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id, n"""


def quality(r: QualityRules = QualityRules()) -> str:
    quoted = [p.replace("'", "''") for p in BOILERPLATE]
    phrases = " + ".join(f"{p.count(' ') + 1} * ((length(low) - length(replace(low, '{p}', ''))) // {len(p.replace(chr(39) * 2, chr(39)))})" for p in quoted)
    return f"""
WITH listed AS (SELECT doc_id, coalesce(text, '') AS t, {_words('text')} AS l FROM documents),
windows AS (SELECT doc_id, i, l[i:i + 4]::VARCHAR AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - 3)) AS i FROM listed)),
often AS (SELECT doc_id, i FROM windows JOIN (SELECT doc_id, w FROM windows GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, w)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM often) GROUP BY 1),
cut AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM listed),
lines AS (SELECT *, {_words('line')} AS ws, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again FROM cut),
filled AS (SELECT *, len(ws) AS n, lower(line) AS low, len(list_filter(ws, lambda w: NOT regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) AS wordless,
    len(list_filter(ws, lambda w: regexp_matches(w, '^\\p{{Lu}}') AND NOT regexp_matches(w, '[.!?,;:]$'))) AS titles, len(list_filter(ws, lambda w: suffix(w, '!!') OR suffix(w, '??'))) AS marked, len(list_distinct(ws)) AS n_distinct,
    len(list_filter(ws, lambda w: strlen(w) > 1 AND upper(w) = w AND lower(w) <> w)) AS shouted FROM lines WHERE len(ws) > 0),
capitals AS (SELECT doc_id, len(list_filter(l, lambda w: upper(w) = w AND lower(w) <> w)) AS capitals FROM listed),
judged AS (SELECT doc_id, n, again, CASE WHEN again AND n >= {r.repeated_line_words} THEN 'repeated' WHEN 100 * {_symbols('line')} > {r.symbol_percent} * n THEN 'navigation'
    WHEN n >= {r.menu_words} AND titles = n THEN 'navigation' WHEN {phrases} > 0 AND 100 * ({phrases}) >= {r.boilerplate_percent} * n THEN 'boilerplate' WHEN 100 * wordless > {r.marks_percent} * n THEN 'punctuation' WHEN 100 * marked > {r.marks_percent} * n THEN 'punctuation'
    WHEN n >= {r.shout_words} AND capitals >= {r.shout_words} AND 100 * shouted > {r.shout_percent} * n THEN 'shouting'
    WHEN n >= {r.repeat_line_words} AND 100 * n_distinct < {r.distinct_percent} * n THEN 'repetition' ELSE '' END AS verdict FROM filled JOIN capitals USING (doc_id)),
lost AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(n) FILTER (verdict <> ''), 0) AS lost,
    coalesce(sum(n) FILTER (verdict = ''), 0) AS stays FROM judged GROUP BY 1),
base AS (SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(list_sum(list_transform(l, lambda w: length(w))), 0)::BIGINT AS word_chars, {_symbols('t')}::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(stays, 0) AS stays
    FROM listed LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND stays > 0 AND 100 * lost <= {r.lost_percent} * n_words AS kept, lost::BIGINT AS n_lost_words
FROM (SELECT *, n_words < {r.base_least_words} OR 100 * n_repeat_words > {r.base_repeat_percent} * n_words AS base_failed FROM base)"""


#: CRC-32 of an ASCII string, a bit at a time.
_crc = lambda s: (
    f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i, 1))::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, n: xor(x >> 1, 3988292384 * (x & 1)))))"
)

#: Cheapest edits by dynamic programming over rows: for each state the least (cost, audit), with what was written.
REPAIR = rf"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
drawn AS (SELECT *, {_crc('k')} % 20 AS d FROM given),
hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last FROM hurt),
judged AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS c, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
sums AS (SELECT g.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM g.conv_id GROUP BY 1),
ways AS (SELECT conv_id, 0::BIGINT AS i, '' AS q, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS w FROM sums
  UNION ALL
  SELECT conv_id, i, q, min(w) AS w FROM (
    SELECT j.conv_id, j.i, CASE e WHEN 'D' THEN p.q WHEN 'K' THEN c WHEN 'R' THEN CASE p.q WHEN 'u' THEN 'a' ELSE 'u' END END AS q,
      {{'cost': p.w.cost + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 't' THEN 1 ELSE 0 END, 'audit': p.w.audit || e,
        'lines': CASE e WHEN 'D' THEN p.w.lines ELSE list_append(p.w.lines, CASE WHEN e = 'K' THEN role WHEN p.q = 'u' THEN 'assistant' ELSE 'user' END || ':' || text) END}} AS w
    FROM (SELECT conv_id, i, unnest([q, CASE q WHEN 'u' THEN 'a' ELSE 'u' END, CASE q WHEN 'u' THEN 'u' ELSE 'a' END]) AS q, unnest([w,
        {{'cost': w.cost + 2, 'audit': w.audit || 'I', 'lines': list_append(w.lines, CASE q WHEN 'u' THEN 'assistant:' ELSE 'user:' END)}},
        {{'cost': w.cost + 4, 'audit': w.audit || 'II', 'lines': w.lines || CASE q WHEN 'u' THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END}}]) AS w FROM ways) p
    JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1, (SELECT unnest(['D', 'K', 'R']) AS e)
    WHERE e = 'D' OR (fault NOT IN ('b', 'd') AND (e = 'R' OR p.q || c IN ('s', 'u', 'su', 'ua', 'au')))) GROUP BY conv_id, i, q),
ended AS (SELECT s.conv_id, min(CASE WHEN q IN ('', 'a') THEN w WHEN q = 'u' THEN {{'cost': w.cost + 2, 'audit': w.audit || 'I', 'lines': list_append(w.lines, 'assistant:')}}
    ELSE {{'cost': w.cost + 4, 'audit': w.audit || 'II', 'lines': w.lines || ['user:', 'assistant:']}} END) AS w FROM sums s JOIN ways y ON y.conv_id IS NOT DISTINCT FROM s.conv_id AND y.i = s.n GROUP BY 1)
SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, w.cost AS cost, w.audit AS audit, sha256(array_to_string(w.lines, chr(10))) AS repaired_sha256 FROM sums s JOIN ended e ON e.conv_id IS NOT DISTINCT FROM s.conv_id"""


def inner_top_k(k: int, every: int, scale: int) -> str:
    return f"""
WITH fine AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM fine q JOIN fine r ON r.vec_id <> q.vec_id AND len(r.v) = len(q.v) WHERE q.vec_id % {every} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM met) WHERE rank <= {k}"""


def collocations(least: int, percent: int, top: int) -> str:
    return rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM texts)),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY 1),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m))),
f AS (SELECT lang, phrase, m, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM f)),
judged AS (SELECT c.lang, c.phrase, a, k, p.f AS l, q.f AS r, ((2000000::HUGEINT * a) // (p.f::HUGEINT + q.f))::BIGINT AS score FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = first JOIN f q ON q.lang = c.lang AND q.phrase = rest),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM judged) WHERE o = 1),
held AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS s) WHERE s < m) GROUP BY 1, 2),
kept AS (SELECT w.* FROM lowest w LEFT JOIN held h ON h.lang = w.lang AND h.phrase = w.phrase WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < {percent}::HUGEINT * w.a)
SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN sizes USING (lang) WHERE rank <= {top}"""
