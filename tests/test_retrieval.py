import json
import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions.lexicon import QUERY_BANK
from tessella.operators import bm25, embedding, expansion, fusion, metrics, rerank, vectors
from tessella.plans.config import RetrievalConfig
from tessella.plans.retrieval import RetrievalPipeline
from tessella.plans.scratch import Scratch
from tessella.sources import readers, writers
from tessella.streaming import ingest


def test_rrf_prefers_overlap(spark):
    ranked = spark.createDataFrame([(1, 1, "a", 0.9, 1), (1, 1, "b", 0.7, 2), (1, 2, "b", 0.8, 1), (1, 2, "c", 0.6, 2)], "query_id int, variant_id int, chunk_id string, score double, rank int").withColumn("n_lists", F.lit(2))
    got = {r.chunk_id: r.score for r in fusion.multi_query_rrf(ranked, 5).collect()}
    assert max(got, key=got.get) == "b"
    assert got["b"] == pytest.approx((1 / 62 + 1 / 61) / 2, abs=1e-8) and got["a"] == pytest.approx(1 / 61 / 2, abs=1e-8)
    assert fusion.multi_query_rrf(ranked.limit(0), 5).count() == 0


def test_expansion(spark):
    rows = spark.createDataFrame([(0, "how to cut latency?"), (1, "kubernetes scaling"), (2, "test query"), (3, " ")], "query_id int, query string")
    syn = {r.query_id: r for r in expansion.expand(rows, "synonyms").collect()}
    assert syn[0].expanded_query == "how to cut latency?, response time, processing delay" and syn[0].expansion_mode == "synonyms"
    assert syn[2].expansion_mode == "full" and syn[2].expanded_query.endswith("including scalability, performance, reliability, system design")
    assert 3 not in syn and syn[0].keywords_added == ["response", "time", "processing", "delay"]
    tech = {r.query_id: r for r in expansion.expand(rows, "technical").collect()}
    assert "related concepts" in tech[1].expanded_query
    assert {r.query_id: r for r in expansion.expand(rows, "hyde").collect()}[1].expanded_query.startswith("In modern distributed systems, kubernetes")
    with pytest.raises(ValueError):
        expansion.expand(rows, "other")


def test_vectors(spark):
    random = np.random.default_rng(0)
    data = [(i, random.normal(size=8).tolist()) for i in range(40)] + [(40, [0.0] * 8), (41, None)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    queries = rows.where("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    for metric in vectors.METRICS:
        got = vectors.exact_top_k(rows, queries, 4, metric).orderBy("query_id", "rank").collect()
        assert [r.rank for r in got] == [1, 2, 3, 4] * 3
        if metric != "inner_product":
            assert [r.vec_id for r in got if r.rank == 1] == [0, 1, 2]
    assert vectors.exact_top_k(rows, queries, 100).count() == 3 * 41
    assert vectors.exact_top_k(rows, queries.limit(0), 3).count() == 0
    ragged = spark.createDataFrame([(50, [1.0, 2.0]), (51, [float("nan")] * 8), (52, []), (53, [None] * 8)], "vec_id long, embedding array<double>")
    both = rows.union(ragged)
    asked = both.withColumnRenamed("vec_id", "query_id")
    found = vectors.exact_top_k(both, asked, 100, "euclidean")
    assert {r.vec_id for r in found.where("query_id = 50").collect()} == {50} and found.where("query_id in (51, 52, 53)").count() == 0


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_blocks_equal_one_block_and_numpy(spark, metric, monkeypatch):
    random = np.random.default_rng(1)
    x = random.normal(size=(120, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    want = {}
    for q in range(0, 120, 4):
        d = {"inner_product": x @ x[q], "cosine": x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])}.get(metric, -((x - x[q]) ** 2).sum(1))
        d = np.round(-np.sqrt(-d) if metric == "euclidean" else d, 6)
        d[q] = -np.inf
        order = np.lexsort((np.arange(120), -d))[:7]
        want |= {(q, n + 1): (int(i), d[i]) for n, i in enumerate(order)}
    def found():
        return {(r.query_id, r["rank"]): (r.vec_id, pytest.approx(r.score, abs=2e-6)) for r in vectors.exact_top_k(rows, queries, 7, metric, other_ids=True).collect()}
    assert want == found()
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 8)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    assert want == found()


def test_inverted_file_recall(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = rows.where("vec_id % 25 = 0").withColumnRenamed("vec_id", "query_id").select("query_id", "embedding")
    exact = {(r.query_id, r.vec_id) for r in vectors.exact_top_k(rows, queries, 5).collect()}
    built = vectors.InvertedFile.build(rows, str(tmp_path / "index"), 16, 10)
    found = {(r.query_id, r.vec_id) for r in built.search(queries, 5).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert {(r.query_id, r.vec_id) for r in vectors.store("ivf", rows, 100_000).search(queries, 5).collect()} == exact
    assert built.rows.count() == rows.count() == sum(r.n for r in built.cells.collect()) and built.rows.select("cell").distinct().count() > 1
    with pytest.raises(ValueError):
        vectors.store("tree", rows)
    assert vectors.store("ivf", rows.limit(0), 4).search(queries, 5).count() == 0


def test_saved_inverted_file_is_pruned(spark, tmp_path, monkeypatch):
    """Clustered vectors: a quarter of the cells and fewer give nine tenths of the answers, and only their folders are read."""
    random = np.random.default_rng(4)
    centres = random.normal(size=(40, 24))
    x = centres[random.integers(0, 40, 6_000)] + 0.35 * random.normal(size=(6_000, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 300 = 0").withColumnRenamed("vec_id", "query_id")
    vectors.InvertedFile.build(rows, str(tmp_path / "index"), 32, 6)
    fits = []
    monkeypatch.setattr(vectors, "fitted_centres", lambda *a: fits.append(a))
    index = vectors.InvertedFile(spark, str(tmp_path / "index"), 6)
    exact = {(r.query_id, r.vec_id) for r in vectors.exact_top_k(rows, queries, 10).collect()}
    found = index.search(queries, 10)
    assert not fits and len(exact & {(r.query_id, r.vec_id) for r in found.collect()}) >= 0.9 * len(exact)
    one = index.search(queries.limit(1), 10)
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().toString()
    want = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 3)
    pruned = index.search(queries, 10)
    assert sorted(map(tuple, pruned.collect())) == want
    assert "dynamicpruning" in pruned._jdf.queryExecution().toString()


def test_equal_vectors_give_k_rows(spark):
    """Ties are cut by id where the rows lie: at most k rows for a query and batch leave a task."""
    compare = vectors._Comparison(10, "cosine", False)
    ids = pa.array(np.random.default_rng(2).permutation(3_000))
    found = compare(pa.array([1, 2]), np.ones((2, 4)), ids, np.ones((3_000, 4)))
    assert found.num_rows == 20 and set(found.column("vec_id").to_pylist()) == set(range(10))
    near = np.ones((50, 4)) + np.arange(50)[:, None] * np.array([1e-9, 0, 0, 0])
    found = compare(pa.array([1]), np.ones((1, 4)), pa.array([f"v{i:02}" for i in range(49, -1, -1)]), near)
    assert sorted(found.column("vec_id").to_pylist()) == [f"v{i:02}" for i in range(10)]


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_registered_inverted_file_recall(spark, folder):
    from tessella.plans import catalog

    sf = f"/root/testdata/{folder}"
    exact = {(r.query_id, r.vec_id) for r in catalog.QUERIES["dense_topk_cosine"](spark, sf).collect()}
    found = {(r.query_id, r.vec_id) for r in catalog.QUERIES["ivf_topk"](spark, sf).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_bm25(spark):
    chunks = spark.createDataFrame([("a", "alpha beta beta"), ("b", "alpha gamma"), ("c", "delta")], "chunk_id string, text string")
    idx = bm25.index(chunks)
    queries = spark.createDataFrame([(1, "beta alpha"), (2, "nothing")], "query_id int, query string")
    got = bm25.search(idx, queries, 3).collect()
    assert {r.query_id for r in got} == {1} and got[0].norm_score <= 1
    filled = bm25.search(idx, queries, 3, include_zero=True).collect()
    assert [(r.query_id, r.chunk_id) for r in sorted(filled, key=lambda r: (r.query_id, r["rank"]))] == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c")]


def bm25_rows(spark):
    """Many chunks of which few hold the rarer words of the queries, some of them repeated."""
    texts = [" ".join(f"word{j}" for j in range(12) if (i * j) % 5 != 1) + (f" rare{i // 100} rare{i // 100}" if i % 100 < 3 else "") for i in range(600)]
    chunks = spark.createDataFrame([(f"d{i // 8}_chunk_{i % 8}", t) for i, t in enumerate([*texts, "", None, *texts[:4]])], "chunk_id string, text string")
    queries = spark.createDataFrame([(i, f"rare{i} word{i} word{i}") for i in range(6)] + [(7, "word2"), (8, "nothing here"), (9, None)], "query_id int, query string")
    return chunks, queries


def plain_bm25(chunks, queries):
    """query_id, chunk_id -> score, by loops."""
    listed = [(r.chunk_id, [w for w in re.findall(r"\w+", (r.text or "").lower()) if len(w) > 2 and w not in bm25.STOPWORDS]) for r in chunks.collect()]
    n, total = len(listed), sum(len(w) for _, w in listed)
    df = Counter(w for _, words in listed for w in set(words))
    raw = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    out = {}
    for q in queries.collect():
        for word in re.findall(r"\w+", (q["query"] or "").lower()):
            for chunk, words in listed:
                if tf := words.count(word):
                    idf = raw[word] if raw[word] >= 0 else 0.25 * mean
                    part = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / (total / n)))
                    out[q.query_id, chunk] = out.get((q.query_id, chunk), 0) + idf * part
    return out


def test_block_maxima_give_the_full_sums_and_read_less(spark):
    chunks, queries = bm25_rows(spark)
    chunks = chunks.dropDuplicates(["chunk_id"]).cache()
    idx = bm25.index(chunks, save=Scratch(spark, "test").save)
    full = bm25.scores(idx, queries)
    assert {(r.query_id, r.chunk_id): round(r.score, 6) for r in full.collect()} == {k: round(v, 6) for k, v in plain_bm25(chunks, queries).items()}
    want = sorted(map(tuple, bm25.top_k(full, 3).collect()))
    found, read = bm25.best_scores(idx, queries, 3)
    assert sorted(map(tuple, bm25.top_k(found, 3).collect())) == want
    every = bm25.bounds(idx, bm25.weighed(idx, queries)).agg(F.sum("n")).head()[0]
    assert read.agg(F.sum("n")).head()[0] < 0.8 * every
    assert "Exchange hashpartitioning(chunk_id" not in full._jdf.queryExecution().toString()


def test_bm25_parts_equal_broadcast(spark, monkeypatch):
    chunks, queries = bm25_rows(spark)
    idx = bm25.index(chunks)
    want = sorted(map(tuple, bm25.search(idx, queries, 6).collect()))
    plain = plain_bm25(chunks.dropDuplicates(["chunk_id"]), queries)
    assert len(want) == sum(min(6, sum(q == i for i, _ in plain)) for q in {i for i, _ in plain})
    monkeypatch.setattr(bm25, "TERMS_IN_TASKS", 0)  # full sums instead of the best in tasks
    assert sorted(map(tuple, bm25.search(idx, queries, 6).collect())) == want
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, bm25.search(idx, queries, 6).collect())) == want
    monkeypatch.setattr(bm25, "PRUNED_POSTINGS", 0)
    assert sorted(map(tuple, bm25.search(idx, queries, 6).collect())) == want


def test_segments_hold_the_terms_and_lengths_of_every_chunk(spark, monkeypatch):
    """Terms are found in Arrow tasks as the column function finds them, however few bytes a task puts into blocks at once."""
    texts = ["The ÉTÉ of été ÉTÉ", "snake_case x1y2 ½½½ ٣٤٥ and\u00a0und", "naïve—naïve a\u0301b\u0301c zz Ωμέγα", "", None, "the of", "漢字仮名 漢字仮名 ab", "straße STRASSE", "one.two...three"] * 30
    chunks = spark.createDataFrame([(f"d{i // 7}_chunk_{i % 7}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    want = {r.chunk_id: Counter(r.t) for r in chunks.select("chunk_id", bm25.terms(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    for size in (bm25.TASK_BYTES, 1):
        monkeypatch.setattr(bm25, "TASK_BYTES", size)
        idx = bm25.index(chunks, save=Scratch(spark, "test").save)
        got = {chunk: Counter() for chunk in want}
        for r in idx.blocks.collect():
            assert r.n == len(r.postings) and r.most_tf == max(p.tf for p in r.postings) and r.least_dl == min(p.dl for p in r.postings)
            for p in r.postings:
                assert r.term not in got[p.chunk_id] and p.dl == want[p.chunk_id].total()
                got[p.chunk_id][r.term] = p.tf
        assert got == want
        assert {r.chunk_id: r.dl for r in idx.lengths.collect()} == {c: w.total() for c, w in want.items()}
        assert tuple(idx.totals.head()) == (len(texts), sum(w.total() for w in want.values()))
    assert tuple(bm25.index(chunks.limit(0)).totals.head()) == (0, 0) and not bm25.index(chunks.limit(0)).stats.count()


@pytest.mark.parametrize("block", [5_000, 40])
def test_keywords_equal_a_plain_loop(spark, monkeypatch, block):
    """1,200 queries: one automaton, or blocks of both sides, and never a pair of every query with every chunk."""
    monkeypatch.setattr(metrics, "BANK_BLOCK", block)
    monkeypatch.setattr(metrics, "CHUNK_BLOCK", 50)
    texts = [None, "", "Alpha BETA", "gamma", *(f"Word{i} and ärger{i % 7} İstanbul" for i in range(120))]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    bank = [(i, [f"WORD{i} ", f"ger{i}"] if i % 3 else [None, "none"]) for i in range(1_195)] + [(2_000, [""]), (2_001, None), (2_002, []), (2_003, ["alpha", "alpha", "ha b"]), (2_004, ["ÄRGER3", "istanbul"])]
    found = metrics.keyword_relevance(chunks, spark.createDataFrame(bank, "query_id int, keywords array<string>"))
    low = {r.chunk_id: r.low for r in chunks.select("chunk_id", F.lower("text").alias("low")).collect()}
    want = sorted((q, c) for q, words in bank for c, t in low.items() if t is not None and any(w is not None and w.lower() in t for w in words or ()))
    assert sorted(map(tuple, found.collect())) == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, False), (1, 2, 0.8, True), (1, 3, 0.7, True), (2, 1, 0.5, False)], "query_id int, rank int, score double, is_rel boolean")
    n_rel = spark.createDataFrame([(1, 3), (2, 0)], "query_id int, n_rel int")
    rows = {r.query_id: r for r in metrics.query_metrics(hits, n_rel).collect()}
    assert rows[1].mrr == 0.5 and rows[1].precision_at_3 == 0.6667 and rows[1].recall_at_3 == 0.6667 and rows[1].ap_at_3 == pytest.approx((1 / 2 + 2 / 3) / 3, abs=1e-4)
    assert rows[2].mrr == 0 and rows[2].recall_at_5 == 0 and rows[2].ndcg_at_5 == 0


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "alpha beta", "x", "alpha beta gamma", 2), (1, "alpha beta", "y", "delta", 1)], "query_id int, query string, chunk_id string, text string, rank int")
    assert rerank.rerank_by_overlap(rows, 1).head().chunk_id == "x"
    assert rerank.no_rerank(rows, 1).head().chunk_id == "y"

    class Length:
        def score(self, queries, texts):
            return [float(len(t)) / 100 for t in texts]

    assert rerank.rerank_by_model(rows, Length(), 2).where("rank = 1").head().chunk_id == "x"


def test_failing_scorer_keeps_the_first_candidates(spark):
    rows = spark.createDataFrame([(q, f"query {q}", f"c{i}", "bad" if (q, i) == (2, 3) else "good" * i, i + 1) for q in (1, 2) for i in range(5)], "query_id int, query string, chunk_id string, text string, rank int")

    class Picky:
        def score(self, queries, texts):
            if "bad" in texts:
                raise ValueError("no")
            return [float(len(t)) for t in texts]

    def broken():
        raise OSError("no model")

    rerank.BATCH_PAIRS, before = 1, rerank.BATCH_PAIRS
    kept = rerank.rerank_by_model(rows, Picky, 3).orderBy("query_id", "rank").collect()
    rerank.BATCH_PAIRS = before
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in kept] == [(1, "c4", 1), (1, "c3", 2), (1, "c2", 3), (2, "c0", 1), (2, "c1", 2), (2, "c2", 3)]
    assert all((r.cross_encoder_score is None) == (r.query_id == 2) for r in kept)
    kept = rerank.rerank_by_model(rows, broken, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in kept] == [(1, "c0"), (1, "c1"), (2, "c0"), (2, "c1")] and all(r.cross_encoder_score is None for r in kept)


def test_models_are_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    class Counting(embedding.HashingEmbedder):
        def __init__(self, dim):
            super().__init__(dim)
            with open(f"{folder}/{os.getpid()}", "a") as file:
                file.write("x")

    embedding.register("counting", Counting)
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "id int, text string").repartition(16)
    found = embedding.embedded(rows, embedding.embedder("counting", 8), batch=5)
    assert found.count() == 400 and found.agg(F.sum(F.size("embedding"))).head()[0] == 3_200
    loads = {p: len((tmp_path / p).read_text()) for p in os.listdir(tmp_path)}
    # many batches and tasks; each evaluation of the column loads a model once in a worker
    assert loads and max(loads.values()) <= 2
    assert embedding.embedder("nothing known", 7).dim == 7


def test_cache(spark, tmp_path, monkeypatch):
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "cache"), buckets=4)
    rows = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, None)], "id int, text string")
    embedder = embedding.HashingEmbedder(16)
    out, stats = embedding.embed_with_cache(rows, embedder, cache)
    assert stats["cache_size"] == 3 and stats["hit_rate"] == 0
    assert out.count() == 4 and stats["misses"] == 3 and out.where("embedding is null").count() == 0
    assert embedding.embed_with_cache(rows, embedder, cache)[1]["misses"] == 0 and cache.size() == 3
    cache.compact()
    assert cache.state() == {"base": 1, "rows": 3, "added": 0, "buckets": 4} and cache.rows().count() == 3
    more = rows.unionByName(spark.createDataFrame([(5, "new text")], "id int, text string"))
    out, stats = embedding.embed_with_cache(more, embedder, cache)
    assert (stats["hits"], stats["misses"], stats["cache_size"]) == (3, 1, 4)
    want = {r.id: r.embedding for r in embedding.embedded(more, embedder).collect()}
    assert {r.id: r.embedding for r in out.collect()} == want
    # a key that is written again counts once, by its last write, in the delta and after the next compaction
    key = cache.base().head().cache_key
    for value in (7.0, 8.0):
        cache.put(spark.createDataFrame([(key, "hashing-16", [value])], "cache_key string, model_name string, embedding array<double>"))
    for _ in range(2):
        assert [r.embedding for r in cache.rows("hashing-16").where(F.col("cache_key") == key).collect()] == [[8.0]] and cache.rows().count() == 4
        cache.compact()
    # another session's object finds the base by its file
    again = embedding.EmbeddingCache(spark, str(tmp_path / "cache"))
    spark.sql(f"DROP TABLE {again._table(again.state()['base'])}")
    assert again.rows().count() == 4 and not (tmp_path / "cache" / "base-1").exists()
    monkeypatch.setattr(embedding.EmbeddingCache, "LEAST_DELTA", 1)
    cache.put(spark.createDataFrame([("k", "m", [1.0])], "cache_key string, model_name string, embedding array<double>"))
    assert cache.state()["added"] == 0 and cache.size() == 5
    cache.clear()
    assert cache.size() == 0 and cache.rows().count() == 0


def test_cached_side_is_not_shuffled(spark, tmp_path):
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "cache"), buckets=4)
    embedder = embedding.HashingEmbedder(8)
    rows = spark.range(500).select("id", F.concat(F.lit("text "), "id").alias("text"))
    embedding.embed_with_cache(rows, embedder, cache)
    cache.compact()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keyed = rows.select("id", embedding.cache_key(embedder.name, F.col("text")).alias("cache_key"))
        found = keyed.join(cache.base().select("cache_key", "embedding"), "cache_key", "left")
        assert found.where("embedding is null").count() == 0
        plan = found._jdf.queryExecution().executedPlan().toString()
        scanned = plan[plan.index("FileScan parquet") - 400 : plan.index("FileScan parquet")]
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in scanned[scanned.rindex("Sort") if "Sort" in scanned else 0 :]
        assert "Window" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_index_by_batches_equals_one_build(spark, tmp_path):
    """Two batches, one of them twice, give the lists of an index of all chunks, though df and average length differ between them."""
    chunks, queries = bm25_rows(spark)
    chunks = chunks.dropDuplicates(["chunk_id"]).cache()
    first = F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == 0
    path = str(tmp_path / "index")
    ingest.add_batch(chunks.where(first), path, 0)
    one = ingest.open_index(spark, path)
    alone = bm25.index(chunks.where(first))
    assert sorted(map(tuple, bm25.search(one, queries, 5).collect())) == sorted(map(tuple, bm25.search(alone, queries, 5).collect()))
    for _ in range(2):  # the second time replaces the first
        ingest.add_batch(chunks.where(~first), path, 1)
    both, whole = ingest.open_index(spark, path), bm25.index(chunks)
    assert sorted(map(tuple, both.stats.select("term", "df", F.round("idf", 9)).collect())) == sorted(map(tuple, whole.stats.select("term", "df", F.round("idf", 9)).collect()))
    want = sorted(map(tuple, bm25.search(whole, queries, 5, include_zero=True).collect()))
    assert sorted(map(tuple, bm25.search(both, queries, 5, include_zero=True).collect())) == want
    assert sorted(map(tuple, bm25.top_k(bm25.best_scores(both, queries, 5)[0], 5).collect())) == sorted(map(tuple, bm25.top_k(bm25.scores(whole, queries), 5).collect()))


def test_sources_and_pipeline(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# Scaling\n" + "Autoscaling adds replicas when traffic spikes occur in the cluster. " * 12)
    (folder / "b.txt").write_bytes("Caching keeps hot rows in memory, so that queries answer fast. \xff".encode("latin-1") * 9)
    (folder / "c.json").write_text('[{"id": "j1", "title": "T", "content": "Circuit breaker patterns isolate faults between services and prevent cascades of failures."}, {"text": ""}]')
    (folder / "d.csv").write_text("no")
    docs = {r.doc_id: r for r in readers.read_files(spark, str(folder)).collect()}
    assert set(docs) == {"a", "b", "j1"} and docs["j1"].metadata["title"] == "T" and docs["j1"].source == "c.json"
    pipe = RetrievalPipeline(spark, RetrievalConfig(similarity_threshold=0.0, embedding_dim=64))
    pipe.ingest([str(folder)], ["An inline text about rate limiting and quotas that is long enough to be kept."])
    with pytest.raises(RuntimeError):
        pipe.retrieve_raw(pipe.queries(["x"]))
    pipe.build()
    queries = pipe.queries(["How does autoscaling work in a cluster?", "circuit breaker"])
    for hits in (pipe.retrieve_raw(queries), pipe.retrieve_enhanced(queries), pipe.retrieve_hybrid(queries)):
        rows = hits.orderBy("query_id", "rank").collect()
        assert rows and all(r.rank <= 5 for r in rows)
    assert pipe.retrieve_hybrid(queries).where("query_id = 1 and rank = 1").head().source == "c.json"
    bank = spark.createDataFrame([(i, q, k) for i, (q, k, _) in enumerate(QUERY_BANK[:2])], "query_id long, query string, keywords array<string>")
    report = pipe._scratch.save(pipe.benchmark(bank, timed=1), "report")
    assert report.count() <= 4 and report.where("latency > 0").select("query_id").distinct().count() <= 1
    told = {"settings": pipe.config.summary(), "queries": pipe.told(bank)}
    text = writers.markdown_report(report, **told)
    assert "* chunk_size: 512" in text and "expanded: " in text and "alone it took a " in text and f"### query 0: {QUERY_BANK[0][0]}" in text
    assert "| mrr |" in writers.markdown_report(report) and "MRR a " in writers.markdown_report(report)
    assert writers.newest_reports(spark, str(tmp_path / "reports")) == []
    paths = [writers.write_report(report, str(tmp_path / "reports"), f"benchmark_{i}", **told) for i in range(2)]
    whole = json.loads(spark.read.text(paths[0] + "/summary").head().value)
    assert whole["settings"]["top_k"] == 5 and whole["n_queries"] == report.select("query_id").distinct().count() and "mrr" in whole["comparison"] and whole["verdict"]
    one = spark.read.json(paths[0] + "/queries").where("query_id = 0").head()
    assert one.query == QUERY_BANK[0][0] and one.change.mrr == pytest.approx(one.strategies.b.mrr - one.strategies.a.mrr, abs=1e-4) and one.winner in ("a", "b", "tie")
    assert [p.rsplit("/", 1)[-1] for p in writers.newest_reports(spark, str(tmp_path / "reports"))] == ["benchmark_1", "benchmark_0"]
    assert spark.read.json(paths[0] + "/queries").count() == report.select("query_id").distinct().count()
    pipe.save_index(str(tmp_path / "index"))
    again = RetrievalPipeline(spark, RetrievalConfig(similarity_threshold=0.0, embedding_dim=64))
    again.load_index(str(tmp_path / "index"))
    assert again.num_chunks() == pipe.num_chunks()


def test_choices_are_wired(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for i in range(12):
        (tmp_path / "docs" / f"{i}.txt").write_text(f"Document number {i} is about topic{i} and also about caching, queues and replicas in clusters. " * 3)
    config = RetrievalConfig(similarity_threshold=0.0, embedding_dim=64, reranking=False, index="ivf", n_cells=4, n_probe=4, cache="parquet", cache_path=str(tmp_path / "cache"))
    pipe = RetrievalPipeline(spark, config)
    pipe.ingest([str(tmp_path / "docs")])
    pipe.build()
    assert isinstance(pipe.index, vectors.InvertedFile) and pipe.telemetry["misses"] == 12
    rows = pipe.retrieve_enhanced(pipe.queries(["topic7 caching"])).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and all(r.cross_encoder_score is None for r in rows)
    pipe.build()
    assert pipe.telemetry["misses"] == 0
    pipe.save_index(str(tmp_path / "index"))
    assert "cell" in spark.read.parquet(str(tmp_path / "index" / "vectors" / "rows")).columns
    again = RetrievalPipeline(spark, config)
    again.load_index(str(tmp_path / "index"))
    asked = pipe.queries(["topic7 caching", "queues"])
    for name in ("retrieve_raw", "retrieve_enhanced", "retrieve_hybrid"):
        columns = [c for c in getattr(pipe, name)(asked).columns]
        assert sorted(map(str, getattr(again, name)(asked).select(columns).collect())) == sorted(map(str, getattr(pipe, name)(asked).collect()))

    class Last:
        def score(self, queries, texts):
            return [float("topic3" in t) for t in texts]

    scored = RetrievalPipeline(spark, RetrievalConfig(similarity_threshold=0.0, embedding_dim=64), scorer=Last())
    scored.load_index(str(tmp_path / "index"))
    assert "topic3" in scored.retrieve_enhanced(scored.queries(["topic3 replicas"])).where("rank = 1").head().text
    with pytest.raises(ValueError):
        embedding.cache_of("redis", spark, "x")
    with pytest.raises(ValueError):
        readers.read_files(spark, __file__)
    with pytest.raises(FileNotFoundError):
        readers.read_files(spark, str(tmp_path / "none"))
    (tmp_path / "settings.yaml").write_text("retrieval:\n  top_k: 7  # more\n  reranking: false\nfusion: 'linear'\n")
    read = RetrievalConfig.read(str(tmp_path / "settings.yaml"))
    assert (read.top_k, read.reranking, read.fusion) == (7, False, "linear") and RetrievalConfig.read("/none") == RetrievalConfig()


def test_rows_and_ground_truth(spark):
    made = {r.doc_id: r for r in readers.from_rows(spark, [{"id": 1, "content": "a text", "tag": 3}, {"text": " "}, {"text": "b", "source": "s"}]).collect()}
    assert set(made) == {"1", "doc_2"} and made["1"].metadata == {"tag": "3"} and made["doc_2"].source == "s"
    chunks = spark.createDataFrame([("x", "Alpha beta"), ("y", "gamma")], "chunk_id string, text string")
    bank = spark.createDataFrame([(1, ["alpha"]), (2, ["none"])], "query_id int, keywords array<string>")
    hits = spark.createDataFrame([(1, "y", 1), (2, "y", 1), (2, "x", 2)], "query_id int, chunk_id string, rank int")
    assert sorted(map(tuple, metrics.ground_truth(metrics.keyword_relevance(chunks, bank), hits).collect())) == [(1, "x"), (2, "y")]


def test_nested_settings(tmp_path, caplog):
    path = tmp_path / "config.yaml"
    path.write_text("# settings\n\nembedding:\n  model: 'hashing-64'   # a model\n  dimension: 64\n  cache_backend: \"sqlite\"\nchunking:\n  chunk_size: 256\n  chunk_overlap: 32\nretrieval:\n  top_k: 7\n  semantic_threshold: 0.1\nvector_store:\n  index_type: \"ivf_flat\"\n  persist_path: \"/tmp/kept\"\nquery_expansion:\n  expansion_type: hyde\nhybrid_search:\n  dense_weight: 0.6\nreranking:\n  enabled: false\nbenchmarking:\n  metrics:\n    - mrr\n  k_values: [1, 3]\nlogging:\n  level: INFO\n")
    read = RetrievalConfig.read(str(path))
    assert (read.model, read.embedding_dim, read.cache, read.cache_path, read.chunk_size, read.chunk_overlap, read.top_k) == ("hashing-64", 64, "sqlite", "/tmp/kept/embeddings", 256, 32, 7)
    assert (read.similarity_threshold, read.index, read.expansion_mode, read.dense_weight, read.reranking) == (0.1, "ivf", "hyde", 0.6, False)
    assert "logging.level" in caplog.text
    path.write_text("nope: 1\n")
    with pytest.raises(ValueError):
        RetrievalConfig.read(str(path))


def test_config():
    with pytest.raises(ValueError):
        RetrievalConfig(chunk_overlap=600)
    with pytest.raises(ValueError):
        RetrievalConfig.of({"nope": 1})


def test_command_line(spark, tmp_path, capsys):
    from tessella.__main__ import main

    (tmp_path / "a.txt").write_text("Rate limiting protects an interface from abuse by quotas and token buckets. " * 10)
    main(["query", "rate limiting", "--data-dir", str(tmp_path), "--strategy", "hybrid", "--json-output"])
    assert "a_chunk_0" in capsys.readouterr().out
    main(["benchmark", "--data-dir", str(tmp_path), "--output", str(tmp_path / "out")])
    assert "| mrr |" in capsys.readouterr().out


def test_files_of_one_stem_and_bad_files(spark, tmp_path):
    """Ids are unique across folders and suffixes; a bad file is a row with its path and an error, in batch and as a stream."""
    folder = tmp_path / "some docs"
    for name, text in {
        "a/readme.md": "# First\nreadme of a", "b/readme.md": "readme of b", "b/readme.txt": "another of b", "top.txt": "on top", "c/bad.json": '{"id": 1, "text": ', "c/none.json": "[]",
        "c/blank.txt": " \n", "c/number.json": "17", "c/good.json": '{"documents": [{"id": "g", "text": "good", "tag": 3}, {"content": "also good"}, {"text": ""}]}', "d/one.json": '{"text": "only one"}', "x.csv": "no",
    }.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    docs = {r.doc_id: r for r in readers.read_files(spark, str(folder)).collect()}
    assert {k: r.text for k, r in docs.items()} == {"a/readme": "# First\nreadme of a", "b/readme.md": "readme of b", "b/readme.txt": "another of b", "top": "on top", "g": "good", "c/good_1": "also good", "d/one_0": "only one"}
    assert docs["g"].metadata["tag"] == "3" and docs["g"].metadata["source_item_index"] == "0" and docs["top"].metadata["file_type"] == "txt" and "source_item_index" not in docs["top"].metadata
    bad = {r.path.rsplit("/", 1)[-1]: r.error for r in readers.file_errors(spark, str(folder)).collect()}
    assert bad == {"bad.json": "no valid JSON", "none.json": "no document with a text", "blank.txt": "no document with a text", "number.json": "no document with a text"}
    stream = readers.scan_stream(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
    stream.awaitTermination()
    came = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.doc_id for r in came if r.error is None} == {"a/readme.md", "b/readme.md", "b/readme.txt", "top.txt", "g", "c/good.json_1", "d/one.json_0"} and sum(r.error is not None for r in came) == 4
    config = RetrievalConfig(similarity_threshold=0.0, embedding_dim=16, min_chunk_size=5)
    pipe = RetrievalPipeline(spark, config)
    pipe.ingest([str(folder)])
    # shorter lines are cleaned away
    assert {r.chunk_id for r in pipe.chunks.collect()} == {"a/readme_chunk_0", "b/readme.md_chunk_0", "b/readme.txt_chunk_0"}
