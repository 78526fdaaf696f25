"""Retrieval strategies over batches of queries (query_id, query)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import bm25, expansion, fusion, rerank, vectors
from tessella.operators.embedding import Embedder, embedded, model_of


Index = DataFrame | vectors.InvertedFile


def dense(index: Index, queries: DataFrame, embedder: Embedder, k: int) -> DataFrame:
    """query_id, chunk_id, score (clipped to [0, 1] after ranking), rank from a table (chunk_id, embedding), one of texts (chunk_id, text), which are
    embedded as they are searched, or an inverted file."""
    asked = embedded(queries, embedder, "query").select("query_id", "embedding")
    if not isinstance(index, vectors.InvertedFile) and "embedding" not in index.columns:
        texts = index.select(F.col("chunk_id").alias("vec_id"), "text")
        found = vectors.exact_top_k_of_texts(texts, asked, k, model_of(embedder))
        if found is not None:
            return found.select("query_id", F.col("vec_id").alias("chunk_id"), vectors.clipped(F.col("score")).alias("score"), "rank")
        index = embedded(index.select("chunk_id", "text"), embedder)
    searched = index if isinstance(index, vectors.InvertedFile) else index.select(F.col("chunk_id").alias("vec_id"), "embedding")
    found = vectors.search_store(searched, asked, k)
    return found.select("query_id", F.col("vec_id").alias("chunk_id"), vectors.clipped(F.col("score")).alias("score"), "rank")


def strategy_a(index: Index, queries: DataFrame, embedder: Embedder, k: int = 5, threshold: float = 0.0) -> DataFrame:
    """Dense search, and only scores from the threshold on."""
    found = dense(index, queries, embedder, k)
    return found.where(F.col("score") >= threshold) if threshold > 0 else found


def strategy_b(
    index: Index, chunks: DataFrame, queries: DataFrame, embedder: Embedder, k: int = 5, mode: str = "full", max_variants: int = 3, threshold: float = 0.0, reranker: rerank.Reranker = rerank.rerank_by_overlap
) -> DataFrame:
    """Expansion, a search for every variant, fusion, reranking, threshold on the best dense score, new ranks.

    cross_encoder_score is null where nothing was reranked."""
    asked = expansion.expand(queries, mode, max_variants)
    lists = asked.select("query_id", F.array_distinct(F.concat(F.array("expanded_query"), "variants")).alias("lists"))
    each = lists.select("query_id", F.size("lists").alias("n_lists"), F.posexplode("lists").alias("variant_id", "query"))
    key = F.struct("query_id", "variant_id")
    found = dense(index, each.select(F.to_json(key).alias("query_id"), "query"), embedder, 2 * k)
    id_type = queries.schema["query_id"].dataType.simpleString()
    back = found.withColumn("__k", F.from_json("query_id", f"query_id {id_type}, variant_id int")).select("__k.*", "chunk_id", "score", "rank")
    ranked = back.join(lists.select("query_id", F.size("lists").alias("n_lists")), "query_id")
    fused = fusion.multi_query_rrf(ranked, 2 * k)
    texts = fused.join(queries, "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    best = reranker(texts, k).where(F.col("raw_score") >= threshold)
    if "cross_encoder_score" not in best.columns:
        best = best.withColumn("cross_encoder_score", F.lit(None).cast("double"))
    order = W.partitionBy("query_id").orderBy("rank")
    return best.select("query_id", "chunk_id", F.col("score").alias("rrf_score"), "raw_score", "cross_encoder_score", F.row_number().over(order).alias("rank"))


def hybrid(index: Index, idx: bm25.Bm25Index, queries: DataFrame, embedder: Embedder, k: int = 5, method: str = "rrf", weight: float = 0.7) -> DataFrame:
    """Dense and BM25 search for 3 k candidates each, fused."""
    left, right = dense(index, queries, embedder, 3 * k), bm25.search(idx, queries, 3 * k)
    return fusion.hybrid_rrf(left, right, k) if method == "rrf" else fusion.hybrid_linear(left, right, k, weight)


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both strategies' results side by side, by query and rank."""
    left = a.select("query_id", "rank", F.col("chunk_id").alias("chunk_a"), F.col("score").alias("score_a"))
    right = b.select("query_id", "rank", F.col("chunk_id").alias("chunk_b"), F.col("score").alias("score_b"))
    return left.join(right, ["query_id", "rank"], "full_outer")
