"""The retrieval pipeline: ingest, index, retrieve, evaluate."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import cleaner, preprocess
from tessella.operators import bm25, chunking, embedding, expansion, metrics, rerank, strategies, vectors
from tessella.operators.embedding import Embedder, embedded
from tessella.plans.config import RetrievalConfig
from tessella.plans.scratch import Scratch, exists
from tessella.plans.ship import ship
from tessella.sources import readers, writers


class RetrievalPipeline:
    """Chunks, vectors and BM25 tables are written once to the shared folder; each retrieval reads what it needs of them."""

    def __init__(self, spark: SparkSession, config: RetrievalConfig = RetrievalConfig(), embedder: Embedder | None = None, scorer: rerank.PairScorer | None = None):
        ship(spark)
        self.spark, self.config = spark, config
        self.embedder = embedder or embedding.embedder(config.model, config.embedding_dim)
        self.reranker = rerank.reranker(config.reranking, scorer)
        self.cache = embedding.cache_of(config.cache, spark, config.cache_path)
        self.telemetry: dict[str, float] = {}
        self.chunks: DataFrame | None = None
        self.vectors: DataFrame | None = None
        self.index: strategies.Index | None = None
        self.terms: bm25.Bm25Index | None = None
        self._scratch = Scratch(spark, "retrieval")
        self._turn = 0

    def _built(self) -> None:
        if self.index is None or self.terms is None:
            raise RuntimeError("build the index first")

    def ingest(self, paths: list[str] = (), texts: list[str] = (), tables: list[DataFrame] = ()) -> DataFrame:
        """Cleans and cuts documents; a new corpus replaces the one before."""
        parts = [readers.read_files(self.spark, p) for p in paths]
        parts += [readers.inline(self.spark, list(texts))] if texts else []
        parts += [readers.from_table(t) for t in tables]
        docs = readers.union(parts)
        cfg = self.config
        if cfg.keep_sections:
            rows = chunking.chunked_by_section(docs, cleaner(), cfg.chunk_size, cfg.chunk_overlap, cfg.min_chunk_size)
        else:
            rows = chunking.chunked(docs.withColumn("text", preprocess(F.col("text"))), cfg.chunk_size, cfg.chunk_overlap, cfg.min_chunk_size)
        self._turn += 1
        self.chunks = self._scratch.save(rows, f"chunks{self._turn}")
        self.index = self.terms = self.vectors = None
        return self.chunks

    def build(self) -> None:
        if self.chunks is None:
            raise RuntimeError("ingest documents first")
        texts = self.chunks.select("chunk_id", "text")
        if self.cache:
            made, self.telemetry = embedding.embed_with_cache(texts, self.embedder, self.cache)
        else:
            made = embedded(texts, self.embedder)
        self._indexed(self._scratch.save(made.select("chunk_id", "embedding"), f"vectors{self._turn}"))

    def _indexed(self, made: DataFrame) -> None:
        """Builds what searches read from chunks and their vectors."""
        cfg, self.vectors = self.config, made
        self.index = made if cfg.index == "flat" else vectors.store(cfg.index, made.withColumnRenamed("chunk_id", "vec_id"), cfg.n_cells, cfg.n_probe)
        self.terms = bm25.index(self.chunks, save=lambda df, name: self._scratch.save(df, f"{name}{self._turn}"))

    def num_chunks(self) -> int:
        return self.chunks.count() if self.chunks is not None else 0

    def queries(self, texts: list[str]) -> DataFrame:
        """Queries of 1 to 2048 characters."""
        if any(not t.strip() or len(t) > 2048 for t in texts):
            raise ValueError("a query has 1 to 2048 characters")
        return self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query string")

    def retrieve_raw(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        self._built()
        return self._texts(strategies.strategy_a(self.index, queries, self.embedder, top_k or self.config.top_k, self.config.similarity_threshold))

    def retrieve_enhanced(self, queries: DataFrame, top_k: int | None = None, mode: str | None = None) -> DataFrame:
        self._built()
        cfg = self.config
        return self._texts(strategies.strategy_b(self.index, self.chunks, queries, self.embedder, top_k or cfg.top_k, mode or cfg.expansion_mode, cfg.max_variants, cfg.similarity_threshold, self.reranker))

    def retrieve_hybrid(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        self._built()
        return self._texts(strategies.hybrid(self.index, self.terms, queries, self.embedder, top_k or self.config.top_k, self.config.fusion, self.config.dense_weight))

    def _texts(self, hits: DataFrame) -> DataFrame:
        """Texts and sources join after ranking, for the hits alone."""
        return hits.join(self.chunks.select("chunk_id", "text", "source", "section"), "chunk_id")

    def latencies(self, bank: DataFrame, most: int, top_k: int | None = None) -> DataFrame:
        """query_id, strategy, latency: what each of the first most queries takes alone, in seconds. As many jobs as that are run, one by one."""
        asked = bank.select("query_id", "query").orderBy("query_id").limit(most)
        kind, rows = bank.schema["query_id"].dataType.simpleString(), []
        for query in asked.collect():  # most rows
            one = self.spark.createDataFrame([tuple(query)], f"query_id {kind}, query string")
            for name, search in (("a", self.retrieve_raw), ("b", self.retrieve_enhanced)):
                began = time.monotonic()
                search(one, top_k).collect()
                rows.append((query["query_id"], name, time.monotonic() - began))
        return self.spark.createDataFrame(rows, f"query_id {kind}, strategy string, latency double")

    def benchmark(self, bank: DataFrame, top_k: int | None = None, timed: int = 0) -> DataFrame:
        """Metrics of strategies A and B for every query of a bank (query_id, query, keywords); relevance is by keywords, or B's
        first hit where no chunk has one. seconds: what a strategy took for the whole bank; latency: what a query took alone, of the first timed ones."""
        self._built()
        queries, runs, took = bank.select("query_id", "query"), {}, {}
        for name, search in (("a", self.retrieve_raw), ("b", self.retrieve_enhanced)):
            began = time.monotonic()
            hits = search(queries, top_k)
            hits = hits if name == "a" else hits.withColumn("score", F.coalesce("cross_encoder_score", "raw_score"))
            runs[name] = self._scratch.save(hits.select("query_id", "rank", "chunk_id", "score"), f"hits-{name}{self._turn}")
            took[name] = time.monotonic() - began
        relevant = self._scratch.save(metrics.ground_truth(metrics.keyword_relevance(self.chunks, bank), runs["b"]), f"relevant{self._turn}")
        n_rel = relevant.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_rel"))
        made = [metrics.query_metrics(metrics.judged(hits, relevant), n_rel).withColumns({"strategy": F.lit(name), "seconds": F.lit(took[name])}) for name, hits in runs.items()]
        return made[0].unionByName(made[1]).join(F.broadcast(self.latencies(bank, timed, top_k)), ["query_id", "strategy"], "left")  # timed rows of each strategy

    def told(self, bank: DataFrame) -> DataFrame:
        """query_id, query, expanded_query, keywords_added of a bank, for a report."""
        made = expansion.expand(bank.select("query_id", "query"), self.config.expansion_mode, self.config.max_variants)
        return made.select("query_id", "query", "expanded_query", "keywords_added")

    def save_index(self, path: str) -> None:
        """chunks, vectors (an inverted file as it was built) and the tables of terms, each as it lies."""
        self._built()
        writers.save_index(self.chunks, f"{path}/chunks")
        if isinstance(self.index, vectors.InvertedFile):
            self.index.copy_to(f"{path}/vectors")
        else:
            writers.save_index(self.vectors, f"{path}/vectors")
        for name, table in self.terms.tables().items():
            writers.save_index(table, f"{path}/terms/{name}")

    def load_index(self, path: str) -> None:
        """Takes a saved index as it lies: nothing is clustered, counted or embedded again."""
        read = lambda name: writers.load_index(self.spark, f"{path}/{name}")
        self.chunks = read("chunks")
        self._turn += 1
        if exists(self.spark, f"{path}/vectors/cells"):
            self.index = vectors.InvertedFile(self.spark, f"{path}/vectors", self.config.n_probe)
            self.vectors = self.index.rows.withColumnRenamed("vec_id", "chunk_id").drop("cell")
        else:
            self.index = self.vectors = read("vectors")
        self.terms = bm25.Bm25Index(**{name: read(f"terms/{name}") for name in bm25.TABLES})
