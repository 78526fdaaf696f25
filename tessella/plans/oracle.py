"""Pieces of SQL (DuckDB) from which the oracle of each registered query is put together."""

from __future__ import annotations

from tessella.functions.lexicon import DOMAIN_TERMS, GENERIC_TERMS, SYNONYMS
from tessella.operators.bm25 import STOPWORDS
from tessella.operators.chunking import HEADER
from tessella.operators.expansion import VARIANTS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def rx(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(to)}, 'g')"


def strip(t: str) -> str:
    return rx(t, r"^\s+|\s+$", "")


def blank_lines(t: str) -> str:
    return f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def markdown(t: str) -> str:
    for pattern, to in ((r"```[`\s]*([\s\S]*?)[`\s]*```", r"\1"), (r"`([^`]+)`", r"\1"), (r"\*{1,3}([^\n]+?)\*{1,3}", r"\1"), (r"\[([^\n]+?)\]\([^\n]+?\)", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"-{4,}", ""), (r"={4,}", "")):
        t = rx(t, pattern, to)
    return t


def lines(t: str) -> str:
    parts = f"string_split({t}, chr(10))"
    return f"(CASE WHEN {t} = '' OR suffix({t}, chr(10)) THEN {parts}[:-2] ELSE {parts} END)"


def boilerplate(t: str) -> str:
    bare = strip("x")
    return f"coalesce(array_to_string(list_transform(list_filter({lines(t)}, lambda x: {bare} = '' OR (NOT regexp_full_match({bare}, '[^a-zA-Z0-9 ]+') AND length({bare}) >= 10)), lambda x: CASE WHEN {bare} = '' THEN '' ELSE x END), chr(10)), '')"


def repeated_lines(l: str) -> str:
    """l: a column that holds the lines."""
    return f"coalesce(array_to_string(list_filter({l}, lambda x, i: i = 1 OR lower({strip('x')}) <> lower({strip(f'{l}[i - 1]')})), chr(10)), '')"


def punctuation(t: str) -> str:
    for mark in "!?.,:;":
        t = rx(t, rf"[{mark}]{{3,}}", mark)
    return t


def spaces(t: str) -> str:
    return blank_lines(rx(t, r"[ \t]+", " "))


def cleaned(source: str = "documents", keys: str = "doc_id, source", p: str = "") -> str:
    """{p}clean (keys, text): texts of source (keys, text) after the whole preprocessing."""
    return f"""
{p}c1 AS (SELECT {keys}, {boilerplate('m')} AS t FROM (SELECT {keys}, {markdown('nfc_normalize(text)')} AS m FROM {source})),
{p}c2 AS (SELECT {keys}, {lines('t')} AS l FROM {p}c1),
{p}clean AS MATERIALIZED (SELECT {keys}, {strip(spaces(punctuation(f"lower({repeated_lines('l')})")))} AS text FROM {p}c2)"""


def cut(keys: str, section: str, order: str, p: str = "") -> str:
    """{p}chunks: windows of {p}clean, numbered within a document by order."""
    return f"""
{p}w0 AS (SELECT {keys}, text AS t, unnest(range(0, length(text), 448)) AS pos FROM {p}clean WHERE length(text) > 0),
{p}w1 AS (SELECT *, least(pos + 512, length(t)) AS e0 FROM {p}w0),
{p}w2 AS (SELECT *, regexp_extract(substr(t, e0 + 1, 80), '^(.*?[.!?])\\s', 1, 's') AS s FROM {p}w1),
{p}w3 AS (SELECT {keys}, pos, CASE WHEN e0 < length(t) AND s <> '' THEN e0 + length(s) + 1 ELSE e0 END AS char_end, t FROM {p}w2),
{p}w4 AS (SELECT *, substr(t, pos + 1, char_end - pos) AS raw FROM {p}w3),
{p}chunks AS MATERIALIZED (SELECT doc_id::VARCHAR || '_chunk_' || (row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - 1) AS chunk_id, {keys},
    (row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - 1)::INTEGER AS chunk_index, pos::INTEGER AS char_start, char_end::INTEGER AS char_end,
    len(list_filter(regexp_split_to_array(raw, '\\s+'), lambda x: x <> ''))::INTEGER AS tokens, {section}{strip('raw')} AS text
    FROM {p}w4 WHERE length({strip('raw')}) >= 50)"""


CLEAN = cleaned()
#: chunks (chunk_id, doc_id, chunk_index, char_start, char_end, tokens, section, text, source): windows of clean.
CHUNKS = f"{CLEAN},{cut('doc_id, source', quoted('general') + ' AS section, ', 'pos')}"

def sectioned(text: str = "text", p: str = "") -> str:
    """{p}sections (doc_id, section_index, section, text, offset): documents, whose text is as given, cut at their headers."""
    return f"""
{p}s0 AS (SELECT doc_id, translate(coalesce({text}, ''), chr(1) || chr(2) || chr(3), '   ') AS whole FROM documents),
{p}s1 AS (SELECT doc_id, whole, string_split(regexp_replace(whole, {quoted('(?m)' + HEADER)}, chr(1) || '\\0' || chr(2) || '\\1\\2\\3' || chr(3), 'g'), chr(1)) AS l FROM {p}s0),
{p}s2 AS (SELECT doc_id, whole, unnest(l) AS x, generate_subscripts(l, 1) AS part FROM {p}s1),
{p}s3 AS (SELECT doc_id, whole, part, CASE WHEN part = 1 THEN '' ELSE split_part(x, chr(2), 1) END AS head, CASE WHEN part = 1 THEN 'preamble' ELSE lower({strip('split_part(split_part(x, chr(3), 1), chr(2), 2)')})[:60] END AS name,
    CASE WHEN part = 1 THEN x ELSE split_part(x, chr(3), 2) END AS body FROM {p}s2),
{p}s4 AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins,
    count(*) OVER (PARTITION BY doc_id) AS n_parts, count(*) FILTER ({strip('body')} <> '') OVER (PARTITION BY doc_id) AS n_filled FROM {p}s3),
{p}s5 AS (SELECT *, n_parts = 1 OR n_filled = 0 AS alone FROM {p}s4),
{p}sections AS MATERIALIZED (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INTEGER AS section_index, CASE WHEN alone THEN 'general' ELSE name END AS section,
    CASE WHEN alone THEN whole ELSE {strip('body')} END AS text, CASE WHEN alone THEN 0 ELSE begins END::INTEGER AS "offset" FROM {p}s5 WHERE CASE WHEN alone THEN part = 1 ELSE {strip('body')} <> '' END)"""


SECTIONS = sectioned()
#: What is put before lines and words of documents: a pattern, and what stands for it in SQL and in Spark.
HEADED = ((r"\n([A-F][a-z]*) ", r"\n## \1\n", "\n## $1\n"), (r"\n([G-L][a-z]*) ", r"\nTHE PART 7:\n\1 ", "\nTHE PART 7:\n$1 "), (r"\n([M-R][a-z]*) ", r"\nSECTION 3: \1\n", "\nSECTION 3: $1\n"))
MARKED = (
    (r"([A-D][a-z]+) ", r"**\1** ", "**$1** "), (r"([E-H][a-z]+) ", r"`\1` ", "`$1` "), (r"([I-M][a-z]+) ", r"[\1](http://a.b/c) ", "[$1](http://a.b/c) "),
    (r"\n([N-R][a-z]+) ", r"\n### \1 ", "\n### $1 "), (r"\n([S-T][a-z]+) ", r"\n-----\n```\n\1\n```\n", "\n-----\n```\n$1\n```\n"), (r"\n([U-Z][a-z]+) ", r"\n======\n*\1* ", "\n======\n*$1* "),
)


def replaced(rules: tuple[tuple[str, str, str], ...]) -> str:
    """text after the rules; a newline is written as chr(10), as SQL keeps \\n in what it puts in."""
    out = "text"
    for pattern, sql, _ in rules:
        parts = " || chr(10) || ".join(quoted(x) for x in sql.split("\\n"))
        out = f"regexp_replace({out}, {quoted(pattern)}, {parts}, 'g')"
    return out


HEADED_SECTIONS = sectioned(replaced(HEADED), "h_")
MARKED_TEXT = replaced(MARKED)


def terms(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(map(quoted, STOPWORDS))}))"


#: stats (term, df, idf) and what scores need of chunks.
BM25_STATS = f"""
listed AS MATERIALIZED (SELECT chunk_id, {terms('text')} AS l FROM chunks),
postings AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(l) AS term FROM listed) GROUP BY 1, 2),
lengths AS (SELECT chunk_id, len(l) AS dl FROM listed),
totals AS (SELECT count(*) AS n_chunks, avg(dl) AS avgdl FROM lengths),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
raw AS MATERIALIZED (SELECT term, df, ln((n_chunks - df + 5e-1) / (df + 5e-1)) AS r FROM df, totals),
stats AS (SELECT term, df, CASE WHEN r < 0 THEN 25e-2 * m ELSE r END AS idf FROM raw, (SELECT avg(r) AS m FROM raw))"""


#: raw (term, df, r) from the distinct terms of each chunk.
TERM_COUNTS = f"""
known AS MATERIALIZED (SELECT unnest(list_distinct({terms('text')})) AS term FROM chunks),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM known GROUP BY 1),
raw AS MATERIALIZED (SELECT term, df, ln((n - df + 5e-1) / (df + 5e-1)) AS r FROM df, (SELECT count(*) AS n FROM chunks))"""


def bm25(k: int, asked: str = "benchmark") -> str:
    """bm (query_id, chunk_id, score, rank, norm_score): the k best chunks of each text of asked (item_id, text)."""
    return f"""
{BM25_STATS.lstrip()},
wanted AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({terms('text')}) AS term FROM {asked}) GROUP BY 1, 2),
scored AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))), 6) AS score
    FROM wanted JOIN stats USING (term) JOIN postings USING (term) JOIN lengths USING (chunk_id), totals GROUP BY 1, 2),
bm_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored),
bm AS (SELECT query_id, chunk_id, score, rank::INTEGER AS rank, score / CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN max(score) OVER (PARTITION BY query_id) ELSE 1e0 END AS norm_score
    FROM bm_ranked WHERE rank <= {k})"""


def hashed(name: str, source: str, key: str, text: str) -> str:
    """name (key, place, v): sparse hashed vectors of length 1."""
    return f"""
{name}_p AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS place, sum(CASE WHEN substr(md5(w), 9, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN 1e0 ELSE -1e0 END) AS v
    FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {source}) GROUP BY 1, 2),
{name}_n AS (SELECT {key}, sqrt(sum(v * v)) AS n FROM {name}_p GROUP BY 1),
{name} AS (SELECT {key}, place, v / n AS v FROM {name}_p JOIN {name}_n USING ({key}) WHERE n > 0)"""


ASKED = "(SELECT item_id AS query_id, text AS query FROM benchmark)"
CHUNK_VECTORS = hashed("cv", "chunks", "chunk_id", "text")


def nearest(k: int, source: str, key: str, p: str = "") -> str:
    """{p}dense (key, chunk_id, score, rank): the k chunks nearest to each query of source (key, query) by hashed vectors."""
    return f"""{hashed(f'{p}qv', source, key, 'query')},
{p}dots AS (SELECT {key}, chunk_id, sum(q.v * c.v) AS d FROM {p}qv q JOIN cv c USING (place) GROUP BY 1, 2),
{p}pairs AS (SELECT a.{key}, c.chunk_id, round(coalesce(d, 0e0), 6) AS s FROM (SELECT {key} FROM {source}) a CROSS JOIN chunks c LEFT JOIN {p}dots d ON d.{key} = a.{key} AND d.chunk_id = c.chunk_id),
{p}dense AS MATERIALIZED (SELECT {key}, chunk_id, greatest(0e0, least(1e0, s)) AS score, rank::INTEGER AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s DESC, chunk_id) AS rank FROM {p}pairs) WHERE rank <= {k})"""


def dense(k: int) -> str:
    return f"{CHUNK_VECTORS},{nearest(k, ASKED, 'query_id')}"


def variants(q: str, f: str, most: int = 3) -> str:
    """The variants of a query q whose full expansion is f."""

    def without(parts) -> str:
        out = f"lower({q})"
        for part in parts:
            out = f"replace({out}, {quoted(part)}, '')"
        return f"trim({out})"

    made = ", ".join([q, *(f"{quoted(begin)} || {without(parts)} || '?'" for begin, parts in VARIANTS), f])
    return f"[{made}][:{most}]"


def enhanced(k: int, threshold: str) -> str:
    """b (query_id, chunk_id, rrf_score, raw_score, cross_encoder_score, rank): expanded multi-query search of the benchmark passages."""
    lists = "(SELECT id, query, list_concat([full_query], v) AS l FROM (SELECT *, " + variants("query", "full_query") + " AS v FROM expanded))"
    return f"""{expansion("(SELECT item_id AS id, text AS query FROM benchmark)")},
lists AS MATERIALIZED (SELECT id AS query_id, query AS asked, {once('l')} AS l FROM {lists}),
each AS MATERIALIZED (SELECT query_id, asked, len(l) AS n_lists, query_id::VARCHAR || '-' || k AS kid, l[k] AS query FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM lists)),
{nearest(2 * k, 'each', 'kid', 'x')},
fused AS (SELECT query_id, asked, chunk_id, round(least(1e0, sum(1e0 / (60 + rank)) / any_value(n_lists)), 9) AS rrf_score, max(score) AS raw_score FROM xdense JOIN each USING (kid) GROUP BY 1, 2, 3),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS r FROM fused) WHERE r <= {2 * k}),
met AS (SELECT f.*, list_distinct({terms('asked')}) AS w, {terms('c.text')} AS t FROM few f JOIN chunks c USING (chunk_id)),
paired AS (SELECT *, round(1e0 / (1e0 + exp(-(8e0 * len(list_filter(w, lambda x: list_contains(t, x))) / greatest(1, len(w)) - 4e0))), 6) AS cross_encoder_score FROM met),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cross_encoder_score DESC, chunk_id) AS place FROM paired),
b AS MATERIALIZED (SELECT query_id, chunk_id, rrf_score, raw_score, cross_encoder_score, row_number() OVER (PARTITION BY query_id ORDER BY place)::INTEGER AS rank FROM best WHERE place <= {k} AND raw_score >= {threshold})"""


def vectors(k: int, score: str, name: str = "found", others: bool = False) -> str:
    """name (query_id, vec_id, score, rank): the k best vectors (others: but itself) for each vector whose id is divisible by 100."""
    return f"""
{name} AS (SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round({score}, 6) AS score
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0) q, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v{' WHERE q.vec_id <> v.vec_id' if others else ''})) WHERE rank <= {k})"""


COSINE = "list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)))"
INNER = "list_dot_product(q.e, v.e)"
EUCLID = "-list_distance(q.e, v.e)"
SQUARED = "-list_sum(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def matched(q: str, table: dict[str, list[str]], n: int) -> str:
    return "flatten([" + ", ".join(f"CASE WHEN contains(lower({q}), {quoted(p)}) THEN {items(t[:n])} ELSE []::VARCHAR[] END" for p, t in table.items()) + "])"


def once(l: str) -> str:
    return f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"


SYNONYM_TERMS = lambda q: matched(q, SYNONYMS, 2)
TECHNICAL_TERMS = lambda q: matched(q, DOMAIN_TERMS, 3)
FULL_TERMS = lambda q: f"list_concat({matched(q, SYNONYMS, 3)}, {matched(q, DOMAIN_TERMS, 2)})"


def expansion(source: str) -> str:
    """expanded (id, query, syn, tech, full_query) from source (id, query)."""
    return f"""
e1 AS (SELECT id, query, {SYNONYM_TERMS('query')} AS s, {TECHNICAL_TERMS('query')} AS t, {FULL_TERMS('query')} AS f FROM {source}),
e2 AS (SELECT *, list_transform(f, lambda x: lower(x)) AS fl FROM e1),
e3 AS (SELECT id, query, {once('s')}[:6] AS syn, {once('t')}[:6] AS tech, list_filter(f, lambda x, i: list_position(fl, lower(x)) = i) AS ff FROM e2),
expanded AS (SELECT id, query, syn, tech, query || ' including ' || array_to_string(CASE WHEN len(ff) = 0 THEN {items(GENERIC_TERMS)} ELSE ff[:8] END, ', ') AS full_query FROM e3)"""


def added(q: str, e: str) -> str:
    """Words of e that q has not, in order, ten at most; e and q are columns."""
    words = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{4,}}')"
    return f"list_filter({words(e)}, lambda x, i: list_position({words(e)}, x) = i AND NOT list_contains({words(q)}, x))[:10]"


def metrics(ranked: str, ks=(1, 3, 5), digits: int = 6) -> str:
    """wide (query_id, strategy, mrr, ...) from ranked (query_id, strategy, rank, score, is_rel) and n_rel (query_id, n_rel)."""
    parts = []
    for k in ks:
        ideal = f"list_sum(list_transform(range(1, least(any_value(n_rel), {k})::INTEGER + 1), lambda i: 1e0 / log2(i + 1e0)))"
        parts += [
            f"round(sum(CASE WHEN rank <= {k} AND is_rel THEN 1 ELSE 0 END) / {k}e0, {digits}) AS precision_at_{k}",
            f"round(coalesce(sum(CASE WHEN rank <= {k} AND is_rel THEN 1e0 ELSE 0e0 END) / nullif(any_value(n_rel), 0), 0e0), {digits}) AS recall_at_{k}",
            f"max(CASE WHEN rank <= {k} AND is_rel THEN 1e0 ELSE 0e0 END) AS hit_rate_at_{k}",
            f"round(coalesce(sum(CASE WHEN rank <= {k} AND is_rel THEN so_far / rank::DOUBLE ELSE 0e0 END) / nullif(least(any_value(n_rel), {k}), 0), 0e0), {digits}) AS ap_at_{k}",
            f"round(coalesce(sum(CASE WHEN rank <= {k} AND is_rel THEN 1e0 / log2(rank + 1e0) ELSE 0e0 END) / nullif({ideal}, 0), 0e0), {digits}) AS ndcg_at_{k}",
            f"round(coalesce(avg(CASE WHEN rank <= {k} THEN score END), 0e0), {digits}) AS semantic_score_at_{k}",
        ]
    return f"""
running AS (SELECT r.*, coalesce(n.n_rel, 0) AS n_rel, sum(is_rel::INTEGER) OVER (PARTITION BY r.query_id, strategy ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so_far FROM {ranked} r LEFT JOIN n_rel n USING (query_id)),
wide AS (SELECT query_id, strategy, round(coalesce(1e0 / min(CASE WHEN is_rel THEN rank END), 0e0), {digits}) AS mrr, {', '.join(parts)} FROM running GROUP BY query_id, strategy)"""
