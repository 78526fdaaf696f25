"""The registered queries of the retrieval operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.functions.lexicon import QUERY_BANK
from tessella.operators import bm25, chunking, embedding, expansion, fusion, metrics, strategies, vectors
from tessella.plans import oracle as o
from tessella.plans.scratch import Scratch
from tessella.plans.ship import ship
from tessella.sources import readers
from tessella.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K = 5


def query(sql: str | None = None):
    """Registers a function (spark, tables) under its name; tables(name) reads a table."""

    def keep(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[function.__name__] = run
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_search"](spark, sf_dir)


def _chunks(tables) -> DataFrame:
    docs = tables("documents").select("doc_id", "source", "text")
    return chunking.chunked(docs.withColumn("text", text.preprocess(F.col("text"))))


def _saved(spark: SparkSession, tables) -> tuple[DataFrame, bm25.Bm25Index]:
    scratch = Scratch(spark, "catalog")
    chunks = scratch.save(_chunks(tables).select("chunk_id", "text", "source"), "chunks")
    return chunks, bm25.index(chunks, save=scratch.save)


def _texts(spark: SparkSession, tables) -> DataFrame:
    """Chunks, written once; a dense search embeds them as it reads them."""
    return Scratch(spark, "catalog").save(_chunks(tables).select("chunk_id", "text", "source"), "chunks")


def _asked(tables) -> DataFrame:
    return tables("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


EMBEDDER = embedding.HashingEmbedder()


# ---- texts


@query(f"SELECT doc_id, {o.strip(o.blank_lines('text'))} AS text FROM (SELECT doc_id, replace(text, chr(9), '    ') AS text FROM documents)")
def text_normalise(spark, tables):
    return tables("documents").select("doc_id", text.strip(text.expand_tabs(text.collapse_blank_lines(F.col("text")))).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfkc_normalise(spark, tables):
    return tables("documents").select("doc_id", text.nfkc(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {o.markdown('text')} AS text FROM documents")
def text_strip_markdown(spark, tables):
    return tables("documents").select("doc_id", text.strip_markdown(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {o.boilerplate('text')} AS text FROM documents")
def text_boilerplate_lines(spark, tables):
    return tables("documents").select("doc_id", text.drop_boilerplate_lines(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {o.repeated_lines('l')} AS text FROM (SELECT doc_id, {o.lines('text')} AS l FROM documents)")
def text_dedup_lines(spark, tables):
    return tables("documents").select("doc_id", text.drop_repeated_lines(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {o.spaces(o.punctuation('lower(text)'))} AS text FROM documents")
def text_squeeze(spark, tables):
    return tables("documents").select("doc_id", text.squeeze_spaces(text.squeeze_punctuation(F.lower("text"))).alias("text"))


@query(f"WITH {o.CLEAN} SELECT doc_id, source, text FROM clean")
def text_preprocess(spark, tables):
    return tables("documents").select("doc_id", "source", text.preprocess(F.col("text")).alias("text"))


@query(f"SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY {o.strip(o.rx('lower(text)', '[ ]*[[:space:]]+', ' '))} ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def doc_exact_dedup(spark, tables):
    return text.exact_dedup(tables("documents")).select("doc_id", "n_chars")


@query("SELECT source, count(*) AS n_docs FROM documents GROUP BY source")
def list_sources(spark, tables):
    return readers.list_sources(tables("documents"))


@query(f"""SELECT bucket, sha256(text) AS text_sha256, length(text) AS n_chars FROM (SELECT bucket, {o.strip("replace(" + o.blank_lines('nfc_normalize(text)') + ", chr(9), '    ')")} AS text
    FROM (SELECT doc_id % 97 AS bucket, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id, text) AS text FROM documents GROUP BY 1)) WHERE text <> ''""")
def document_files(spark, tables):
    """Documents written as text files, a folder each for every 97th, and read as files of documents of many folders."""
    scratch = Scratch(spark, "files")
    lines = tables("documents").select(F.pmod("doc_id", F.lit(97)).alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "text").select("bucket", "text").write.partitionBy("bucket").text(f"{scratch.root}/in")
    docs = readers.read_files(spark, f"{scratch.root}/in")
    bucket = F.regexp_extract("doc_id", r"^bucket=(\d+)/", 1).cast("long")
    return docs.select(bucket.alias("bucket"), F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT event_id, event_type, array_to_string(json_keys(props), ' ') AS fields, length(props) AS n_chars FROM events")
def json_extra_fields(spark, tables):
    fields = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    return tables("events").select("event_id", "event_type", F.array_join(fields, " ").alias("fields"), F.length("props").cast("long").alias("n_chars"))


@query("SELECT event_type, count(*) AS n, avg(value) AS mean_value, stddev_samp(value) AS std_value, quantile_cont(value, 95e-2) AS p95_value FROM events GROUP BY event_type")
def latency_profile(spark, tables):
    return metrics.latency_profile(tables("events"), "value", "event_type")


# ---- chunks


@query("SELECT doc_id, pos::INTEGER AS pos, least(pos + 512, length(text))::INTEGER AS char_end, substr(text, pos + 1, 512) AS raw FROM (SELECT doc_id, text, unnest(range(0, length(text), 448)) AS pos FROM documents)")
def chunk_windows(spark, tables):
    return chunking.windows(tables("documents").select("doc_id", "text"), snap=False).select("doc_id", "pos", "char_end", "raw")


@query(f"WITH {o.CHUNKS} SELECT * FROM chunks")
def chunk_sentence_aligned(spark, tables):
    return _chunks(tables)


@query(f"WITH {o.CHUNKS} SELECT source, count(*) AS n_chunks, sum(tokens)::BIGINT AS n_tokens, max(tokens) AS most_tokens, count(DISTINCT doc_id) AS n_docs FROM chunks GROUP BY source")
def chunk_stats(spark, tables):
    return _chunks(tables).groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("most_tokens"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {o.SECTIONS} SELECT * FROM sections")
def chunk_sections(spark, tables):
    """Sections of documents at their headers."""
    return chunking.sections(tables("documents").select("doc_id", "text"))


def _with_headers(tables) -> DataFrame:
    """Documents whose lines, by their first letter, begin with a header of each kind; the tables hold none."""
    marked = F.col("text")
    for pattern, _, java in o.HEADED:
        marked = F.regexp_replace(marked, pattern, java)
    return tables("documents").select("doc_id", marked.alias("text"))


@query(f"WITH {o.HEADED_SECTIONS} SELECT * FROM h_sections")
def headed_sections(spark, tables):
    """Sections of documents that were given headers."""
    return chunking.sections(_with_headers(tables))


@query(f"""WITH {o.HEADED_SECTIONS},{o.cleaned('h_sections', 'doc_id, section_index, section', 's_')},{o.cut('doc_id, section_index, section', '', 'section_index, pos', 's_')}
SELECT chunk_id, doc_id, section_index, section, chunk_index, char_start, char_end, tokens, text FROM s_chunks""")
def headed_section_chunks(spark, tables):
    """Chunks of the sections of documents that were given headers."""
    return chunking.chunked_by_section(_with_headers(tables)).select("chunk_id", "doc_id", "section_index", "section", "chunk_index", "char_start", "char_end", "tokens", "text")


@query(f"SELECT doc_id, {o.markdown(o.MARKED_TEXT)} AS text FROM documents")
def marked_strip_markdown(spark, tables):
    """Markdown taken off documents that were given marks of every kind; the tables hold none."""
    marked = F.col("text")
    for pattern, _, java in o.MARKED:
        marked = F.regexp_replace(marked, pattern, java)
    return tables("documents").select("doc_id", text.strip_markdown(marked).alias("text"))


@query(f"WITH {o.CHUNKS} SELECT chunk_id, doc_id, chunk_index, tokens, text FROM chunks")
def streaming_chunks(spark, tables):
    """Documents read as a stream of files and cut; the stream ends when all files are read."""
    docs = tables("documents").select("doc_id", "source", "text")
    scratch = Scratch(spark, "stream")
    scratch.save(docs, "in")
    chunks = ingest.stream_chunks(spark, f"{scratch.root}/in", docs.schema)
    ingest.write_chunks(chunks.select("chunk_id", "doc_id", "chunk_index", "tokens", "text"), f"{scratch.root}/out", f"{scratch.root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{scratch.root}/out")


@query(f"""WITH {o.SECTIONS},{o.cleaned('sections', 'doc_id, section_index, section', 's_')},{o.cut('doc_id, section_index, section', '', 'section_index, pos', 's_')}
SELECT chunk_id, doc_id, section_index, section, chunk_index, char_start, char_end, tokens, text FROM s_chunks""")
def section_chunks(spark, tables):
    """Documents cut at their headers, then each section cleaned and cut; chunks are numbered over the document."""
    return chunking.chunked_by_section(tables("documents").select("doc_id", "text")).select(
        "chunk_id", "doc_id", "section_index", "section", "chunk_index", "char_start", "char_end", "tokens", "text"
    )


# ---- BM25


@query(f"WITH {o.CHUNKS} SELECT chunk_id, coalesce(array_to_string({o.terms('text')}, ' '), '') AS terms FROM chunks")
def tokenise(spark, tables):
    return _chunks(tables).select("chunk_id", F.array_join(bm25.terms(F.col("text")), " ").alias("terms"))


@query(f"""WITH {o.CHUNKS}, {o.TERM_COUNTS} SELECT term, df, round(CASE WHEN r < 0 THEN 25e-2 * (SELECT avg(r) FROM raw) ELSE r END, 9) AS idf FROM raw""")
def bm25_term_stats(spark, tables):
    return _saved(spark, tables)[1].stats.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {o.CHUNKS}, {o.bm25(K)} SELECT query_id, chunk_id, score, rank, round(norm_score, 6) AS norm_score FROM bm")
def bm25_topk(spark, tables):
    _, idx = _saved(spark, tables)
    return bm25.search(idx, _asked(tables), K).select("query_id", "chunk_id", "score", "rank", F.round("norm_score", 6).alias("norm_score"))


def _short(tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return tables("benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 1, 5), " ").alias("query"))


_FIRST_WORDS = r"(SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[1:5], ' ') AS text FROM benchmark)"


@query(f"""WITH {o.CHUNKS}, {o.bm25(K, _FIRST_WORDS)} SELECT query_id, chunk_id, score, rank, round(norm_score, 6) AS norm_score FROM bm""")
def bm25_block_max(spark, tables):
    """Short queries, the first five words of each passage, through block maxima: postings that cannot matter are not read."""
    _, idx = _saved(spark, tables)
    found = bm25.normalised(bm25.top_k(bm25.best_scores(idx, _short(tables), K)[0], K))
    return found.select("query_id", "chunk_id", "score", "rank", F.round("norm_score", 6).alias("norm_score"))


@query(f"""WITH {o.CHUNKS}, {o.bm25(60)},
filled AS (SELECT query_id, chunk_id, score FROM bm UNION ALL SELECT query_id, chunk_id, 0e0 FROM (SELECT item_id AS query_id FROM benchmark), (SELECT chunk_id FROM chunks ORDER BY chunk_id LIMIT 120) c
    WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM bm) AND query_id IN (SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM bm WHERE rank = 60)))
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM filled) WHERE rank <= 60""")
def bm25_include_zero(spark, tables):
    """Lists of 60 chunks, filled up with chunks that match nothing."""
    _, idx = _saved(spark, tables)
    return bm25.search(idx, _asked(tables), 60, include_zero=True).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {o.CHUNKS}, {o.bm25(K)} SELECT query_id, chunk_id, score, rank, round(norm_score, 6) AS norm_score FROM bm")
def incremental_bm25(spark, tables):
    """Documents that arrive in two files are added to an index, a batch each; a search sees the chunks, df and average length of both."""
    scratch = Scratch(spark, "incremental")
    docs = tables("documents").select("doc_id", "source", "text")
    for part in (0, 1):
        docs.where(F.pmod("doc_id", F.lit(2)) == part).write.mode("append").parquet(f"{scratch.root}/in/part={part}")
    files = max(1, docs.rdd.getNumPartitions())  # each half has as many
    ingest.index_stream(spark, f"{scratch.root}/in/*", docs.schema, f"{scratch.root}/index", f"{scratch.root}/checkpoint", files_at_once=files).awaitTermination()
    scratch.drop("in")
    idx = ingest.open_index(spark, f"{scratch.root}/index", scratch.save)
    return bm25.search(idx, _asked(tables), K).select("query_id", "chunk_id", "score", "rank", F.round("norm_score", 6).alias("norm_score"))


# ---- vectors


def _queries(tables) -> DataFrame:
    return tables("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {o.vectors(10, o.COSINE)} SELECT * FROM found")
def dense_topk_cosine(spark, tables):
    return vectors.exact_top_k(tables("embeddings"), _queries(tables), 10)


@query(f"WITH {o.vectors(10, o.INNER)} SELECT * FROM found")
def dense_topk_inner_product(spark, tables):
    return vectors.exact_top_k(tables("embeddings"), _queries(tables), 10, "inner_product")


@query(f"WITH {o.vectors(10, o.EUCLID, others=True)} SELECT * FROM found")
def dense_topk_euclid(spark, tables):
    return vectors.exact_top_k(tables("embeddings"), _queries(tables), 10, "euclidean", other_ids=True)


@query(f"WITH {o.vectors(10, o.SQUARED, others=True)} SELECT query_id, vec_id, score, -score AS distance, rank FROM found")
def dense_topk_squared(spark, tables):
    found = vectors.exact_top_k(tables("embeddings"), _queries(tables), 10, "squared_euclidean", other_ids=True)
    return found.withColumn("distance", -F.col("score"))


@query(f"WITH {o.vectors(10, o.COSINE)} SELECT * FROM found WHERE score >= 5e-1")
def dense_threshold(spark, tables):
    return vectors.exact_top_k(tables("embeddings"), _queries(tables), 10).where("score >= 0.5")


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS length, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round(list_sum(list_transform(e, lambda x: abs(x))) / sqrt(list_dot_product(e, e)), 6) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def l2_normalise(spark, tables):
    unit = tables("embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"), vectors.l2_normalised(F.col("embedding")).alias("unit"))
    total = F.aggregate("unit", F.lit(0.0), lambda s, x: s + F.abs(x))
    return unit.select("vec_id", "length", F.round(F.col("unit")[0], 6).alias("first"), F.round(total, 6).alias("total"))


@query()
def ivf_topk(spark, tables):
    """Approximate search through cells of k-means; recall is tested against the exact search."""
    return vectors.store("ivf", tables("embeddings"), n_cells=32, n_probe=18).search(_queries(tables), 10)


_LISTS = f"{o.vectors(20, o.COSINE, 'l0')},{o.vectors(20, o.EUCLID, 'l1')}"


@query(f"""WITH {_LISTS}, two AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
fused AS (SELECT query_id, vec_id::VARCHAR AS chunk_id, round(least(1e0, sum(1e0 / (60 + rank)) / 2), 9) AS score FROM two GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM fused) WHERE rank <= 10""")
def rrf_multi_query(spark, tables):
    lists = [vectors.exact_top_k(tables("embeddings"), _queries(tables), 20, m).withColumn("variant_id", F.lit(i)) for i, m in enumerate(("cosine", "euclidean"))]
    ranked = lists[0].unionByName(lists[1]).withColumn("n_lists", F.lit(2)).withColumn("chunk_id", F.col("vec_id").cast("string"))
    return fusion.multi_query_rrf(ranked, 10).select("query_id", "chunk_id", "score", "rank")


# ---- strategies over texts


@query(f"WITH {o.CHUNKS}, {o.dense(K)} SELECT query_id, chunk_id, score, rank FROM dense WHERE score >= 25e-2")
def strategy_a(spark, tables):
    return strategies.strategy_a(_texts(spark, tables), _asked(tables), EMBEDDER, K, 0.25)


_BOTH = f"""{o.CHUNKS}, {o.dense(3 * K)}, {o.bm25(3 * K)},
sides AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.chunk_id) AS chunk_id, coalesce(d.score, 0e0) AS dense_score, coalesce(b.norm_score, 0e0) AS bm25_score, d.rank AS dr, b.rank AS br
    FROM dense d FULL JOIN bm b ON d.query_id = b.query_id AND d.chunk_id = b.chunk_id),
counted AS (SELECT *, count(dr) OVER (PARTITION BY query_id) AS nd, count(br) OVER (PARTITION BY query_id) AS nb FROM sides)"""


def _fused(score: str) -> str:
    return f"""WITH {_BOTH}, fused AS (SELECT *, round({score}, 9) AS score FROM counted)
SELECT query_id, chunk_id, round(score, 6) AS score, rank, coalesce(dr, 9999) AS dense_rank, coalesce(br, 9999) AS bm25_rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM fused) WHERE rank <= {K}"""


def _hybrid(spark, tables, method: str) -> DataFrame:
    scratch = Scratch(spark, "catalog")
    chunks = _texts(spark, tables)
    found = strategies.hybrid(chunks, bm25.index(chunks, save=scratch.save), _asked(tables), EMBEDDER, K, method)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "dense_rank", "bm25_rank")


_RRF = "least(1e0, (1e0 / (60 + coalesce(dr, nd + 60)) + 1e0 / (60 + coalesce(br, nb + 60))) / (2e0 / 61))"


@query(_fused(_RRF))
def hybrid_search(spark, tables):
    return _hybrid(spark, tables, "rrf")


@query(_fused("7e-1 * dense_score + (1e0 - 7e-1) * bm25_score"))
def hybrid_linear(spark, tables):
    return _hybrid(spark, tables, "linear")


@query(f"WITH {o.CHUNKS},{o.CHUNK_VECTORS},{o.enhanced(K, '25e-2')} SELECT * FROM b")
def strategy_b(spark, tables):
    """Expanded multi-query search with fusion and reranking."""
    chunks = _texts(spark, tables)
    return strategies.strategy_b(chunks, chunks, _asked(tables), EMBEDDER, K, threshold=0.25)


def _benchmark(spark, tables) -> DataFrame:
    """Metrics of strategies A and B for every benchmark passage; relevant are chunks that hold one of its first two runs of three words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    runs = F.array(*[F.array_join(F.slice(words, at, 3), " ") for at in (1, 4)])
    bank = tables("benchmark").select(F.col("item_id").alias("query_id"), F.filter(runs, lambda r: r != "").alias("keywords"))
    chunks = _texts(spark, tables)
    scratch = Scratch(spark, "catalog")
    a = scratch.save(strategies.strategy_a(chunks, _asked(tables), EMBEDDER, K).select("query_id", "chunk_id", "score", "rank"), "a")
    b = strategies.strategy_b(chunks, chunks, _asked(tables), EMBEDDER, K)
    b = scratch.save(b.select("query_id", "chunk_id", F.col("cross_encoder_score").alias("score"), "rank"), "b")
    relevant = scratch.save(metrics.ground_truth(metrics.keyword_relevance(chunks, bank), b), "relevant")
    n_rel = relevant.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_rel"))
    hits = a.withColumn("strategy", F.lit("a")).unionByName(b.withColumn("strategy", F.lit("b")))
    return metrics.query_metrics(metrics.judged(hits, relevant), n_rel, by=("strategy",), digits=6)


_RUNS = "list_filter([array_to_string(w[1:3], ' '), array_to_string(w[4:6], ' ')], lambda x: x <> '')"
_BENCH = f"""{o.CHUNKS},{o.dense(K)},{o.enhanced(K, '0e0')},
bank AS (SELECT query_id, {_RUNS} AS keywords FROM (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark)),
held AS MATERIALIZED (SELECT query_id, chunk_id FROM bank, chunks WHERE len(list_filter(keywords, lambda w: contains(text, w))) > 0),
relevant AS MATERIALIZED (SELECT * FROM held UNION ALL SELECT query_id, chunk_id FROM b WHERE rank = 1 AND query_id NOT IN (SELECT query_id FROM held)),
n_rel AS (SELECT query_id, count(*)::INTEGER AS n_rel FROM relevant GROUP BY 1),
bench AS (SELECT h.*, r.chunk_id IS NOT NULL AS is_rel FROM (SELECT query_id, 'a' AS strategy, chunk_id, score, rank FROM dense UNION ALL SELECT query_id, 'b', chunk_id, cross_encoder_score, rank FROM b) h
    LEFT JOIN relevant r ON r.query_id = h.query_id AND r.chunk_id = h.chunk_id),
{o.metrics('bench')}"""


@query(f"WITH {_BENCH} SELECT * FROM wide")
def benchmark_metrics(spark, tables):
    return _benchmark(spark, tables)


@query(f"""WITH {_BENCH}, means AS (SELECT round(avg(mrr) FILTER (strategy = 'a'), 4) AS a, round(avg(mrr) FILTER (strategy = 'b'), 4) AS b FROM wide),
wins AS (SELECT count(*) FILTER (x.mrr > y.mrr) AS wins_a, count(*) FILTER (y.mrr > x.mrr) AS wins_b, count(*) FILTER (x.mrr = y.mrr) AS ties FROM (SELECT * FROM wide WHERE strategy = 'a') x JOIN (SELECT * FROM wide WHERE strategy = 'b') y USING (query_id)),
said AS (SELECT *, CASE WHEN b - a > 1e-1 THEN 'strong improvement' WHEN b - a > 0 THEN 'slight improvement' WHEN b - a < -5e-2 THEN 'decline' ELSE 'comparable' END AS verdict FROM means, wins)
SELECT verdict, printf('MRR a %.4f, b %.4f (%+.4f): %s; wins a %d, b %d, ties %d', a, b, b - a, verdict, wins_a, wins_b, ties) AS summary FROM said""")
def benchmark_summary(spark, tables):
    wide = Scratch(spark, "catalog").save(_benchmark(spark, tables), "wide")
    return metrics.summary(metrics.mean_metrics(metrics.long_form(wide)), metrics.win_loss_tie(wide, "a", "b"))


@query(f"""WITH {o.CHUNKS}, {o.dense(K)}, {o.bm25(K)}
SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.rank, b.rank) AS rank, d.chunk_id AS chunk_a, d.score AS score_a, b.chunk_id AS chunk_b, b.score AS score_b
FROM dense d FULL JOIN bm b ON d.query_id = b.query_id AND d.rank = b.rank""")
def side_by_side(spark, tables):
    chunks = _texts(spark, tables)
    return strategies.paired(strategies.dense(chunks, _asked(tables), EMBEDDER, K), bm25.search(bm25.index(chunks, save=Scratch(spark, "catalog").save), _asked(tables), K))


# ---- expansion


def _turns(tables) -> DataFrame:
    return tables("conversations").where("trim(text) <> ''").select("conv_id", "turn", F.col("text").alias("query"))


_TURNS = "(SELECT conv_id::VARCHAR || '-' || turn AS id, text AS query FROM conversations WHERE trim(text) <> '')"


def _expanded(tables, mode: str) -> DataFrame:
    rows = _turns(tables).withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return expansion.expand(rows, mode).select("id", "expanded_query", "expansion_mode", F.array_join("keywords_added", " ").alias("keywords_added"))


def _expansion_sql(chosen: str, mode: str) -> str:
    return f"WITH {o.expansion(_TURNS)}, x AS (SELECT id, query, {chosen} AS expanded_query, {mode} AS expansion_mode FROM expanded) SELECT id, expanded_query, expansion_mode, array_to_string({o.added('query', 'expanded_query')}, ' ') AS keywords_added FROM x"


@query(_expansion_sql("CASE WHEN len(syn) > 0 THEN query || ', ' || array_to_string(syn, ', ') ELSE full_query END", "CASE WHEN len(syn) > 0 THEN 'synonyms' ELSE 'full' END"))
def expand_synonyms(spark, tables):
    return _expanded(tables, "synonyms")


@query(_expansion_sql("CASE WHEN len(tech) > 0 THEN query || ' — related concepts: ' || array_to_string(tech, ', ') ELSE full_query END", "CASE WHEN len(tech) > 0 THEN 'technical' ELSE 'full' END"))
def expand_technical(spark, tables):
    return _expanded(tables, "technical")


@query(_expansion_sql("full_query", "'full'"))
def expand_full(spark, tables):
    return _expanded(tables, "full")


@query(_expansion_sql(f"{o.quoted(expansion.PASSAGE[0])} || full_query || {o.quoted(expansion.PASSAGE[1])}", "'hyde'"))
def expand_hyde(spark, tables):
    return _expanded(tables, "hyde")


@query(f"WITH {o.expansion(_TURNS)}, v AS (SELECT id, {o.once('l')} AS v FROM (SELECT id, {o.variants('query', 'full_query')} AS l FROM expanded)) SELECT id, (unnest(range(1, len(v) + 1)) - 1)::INTEGER AS variant_id, unnest(v) AS variant FROM v")
def query_variants(spark, tables):
    rows = _turns(tables).withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return expansion.expand(rows).select("id", F.posexplode("variants").alias("variant_id", "variant"))


# ---- evaluation


def _bank(spark) -> DataFrame:
    return spark.createDataFrame([(i, q, k) for i, (q, k, _) in enumerate(QUERY_BANK)], "query_id int, query string, keywords array<string>")


_BANK = "(VALUES " + ", ".join(f"({i}, {o.items(k)})" for i, (_, k, _) in enumerate(QUERY_BANK)) + ") AS bank(query_id, keywords)"


@query(f"WITH {o.CHUNKS} SELECT query_id, chunk_id FROM chunks, {_BANK} WHERE len(list_filter(keywords, lambda w: contains(lower(text), lower(w)))) > 0")
def keyword_ground_truth(spark, tables):
    return metrics.keyword_relevance(_chunks(tables), _bank(spark))


def _judged(tables) -> tuple[DataFrame, DataFrame]:
    """Two strategies' hits for the query vectors but themselves, relevant if of the same label, and the number of relevant rows of each query."""
    rows = tables("embeddings")
    label = rows.select("vec_id", "label")
    asked = _queries(tables).join(label.withColumnRenamed("vec_id", "query_id").withColumnRenamed("label", "query_label"), "query_id")
    runs = [vectors.exact_top_k(rows, _queries(tables), 10, m, other_ids=True).withColumn("strategy", F.lit(s)) for s, m in (("a", "cosine"), ("b", "euclidean"))]
    hits = runs[0].unionByName(runs[1]).join(label, "vec_id").join(asked.select("query_id", "query_label"), "query_id")
    hits = hits.select("query_id", "strategy", "rank", "score", (F.col("label") == F.col("query_label")).alias("is_rel"))
    sizes = rows.groupBy(F.col("label").alias("query_label")).agg((F.count(F.lit(1)) - 1).cast("int").alias("n_rel"))
    return hits, asked.join(sizes, "query_label").select("query_id", "n_rel")


_JUDGED = f"""{o.vectors(10, o.COSINE, 'ra', True)},{o.vectors(10, o.EUCLID, 'rb', True)},
hits AS (SELECT r.query_id, strategy, rank, score, v.label = q.label AS is_rel FROM (SELECT *, 'a' AS strategy FROM ra UNION ALL SELECT *, 'b' FROM rb) r
    JOIN embeddings v USING (vec_id) JOIN embeddings q ON q.vec_id = r.query_id),
n_rel AS (SELECT vec_id AS query_id, n_rel FROM embeddings JOIN (SELECT label, (count(*) - 1)::INTEGER AS n_rel FROM embeddings GROUP BY 1) USING (label) WHERE vec_id % 100 = 0),
{o.metrics('hits')}"""
_NAMES = ["mrr", *(f"{m}_at_{k}" for k in metrics.KS for m in ("precision", "recall", "hit_rate", "ap", "ndcg"))]
_MEANS = f"{_JUDGED}, long AS (UNPIVOT (SELECT query_id, strategy, {', '.join(_NAMES)} FROM wide) ON {', '.join(_NAMES)} INTO NAME metric VALUE value), means AS (SELECT strategy, metric, round(avg(value), 6) AS mean_value FROM long GROUP BY 1, 2)"


def _wide(tables) -> DataFrame:
    hits, n_rel = _judged(tables)
    return metrics.query_metrics(hits, n_rel, by=("strategy",), digits=6)


@query(f"WITH {_JUDGED} SELECT * FROM wide")
def retrieval_metrics(spark, tables):
    return _wide(tables)


@query(f"WITH {_MEANS} SELECT * FROM means")
def metrics_mean(spark, tables):
    return metrics.mean_metrics(metrics.long_form(_wide(tables).select("query_id", "strategy", *_NAMES)), digits=6)


@query(f"WITH {_MEANS} SELECT metric, a.mean_value AS value_a, b.mean_value AS value_b, round(b.mean_value - a.mean_value, 4) AS delta, CASE WHEN a.mean_value > 0 THEN round((b.mean_value - a.mean_value) / a.mean_value * 100, 1) END AS improvement_percent FROM (SELECT * FROM means WHERE strategy = 'a') a JOIN (SELECT * FROM means WHERE strategy = 'b') b USING (metric)")
def strategy_compare(spark, tables):
    return metrics.compare(metrics.mean_metrics(metrics.long_form(_wide(tables).select("query_id", "strategy", *_NAMES)), digits=6), "a", "b")


@query(f"WITH {_JUDGED} SELECT count(*) FILTER (a.mrr > b.mrr) AS wins_a, count(*) FILTER (b.mrr > a.mrr) AS wins_b, count(*) FILTER (a.mrr = b.mrr) AS ties FROM (SELECT * FROM wide WHERE strategy = 'a') a JOIN (SELECT * FROM wide WHERE strategy = 'b') b USING (query_id)")
def win_loss_tie(spark, tables):
    return metrics.win_loss_tie(_wide(tables), "a", "b")


# ---- cache

_KEY = "sha256('hashing-384::' || text)"


@query(f"SELECT doc_id, {_KEY} AS cache_key FROM documents")
def cache_keys(spark, tables):
    return tables("documents").select("doc_id", embedding.cache_key("hashing-384", F.col("text")).alias("cache_key"))


@query(f"SELECT DISTINCT {_KEY} AS cache_key FROM documents WHERE {_KEY} NOT IN (SELECT {_KEY} FROM benchmark)")
def cache_misses(spark, tables):
    key = embedding.cache_key("hashing-384", F.col("text")).alias("cache_key")
    return embedding.misses(tables("documents").select(key), tables("benchmark").select(key))


@query(f"SELECT cache_key, arg_max(doc_id, doc_id) AS doc_id FROM (SELECT doc_id, {_KEY} AS cache_key FROM documents) GROUP BY 1")
def cache_upsert(spark, tables):
    """The last write of each key, as if documents had been written in order of their ids."""
    rows = tables("documents").select(embedding.cache_key("hashing-384", F.col("text")).alias("cache_key"), "doc_id", F.col("doc_id").alias("created_at"))
    return embedding.latest(rows).select("cache_key", "doc_id")
