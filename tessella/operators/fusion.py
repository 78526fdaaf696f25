"""Fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.bm25 import top_k

K_RRF = 60
NO_RANK = 9999


def multi_query_rrf(ranked: DataFrame, k: int, n_lists: str = "n_lists") -> DataFrame:
    """query_id, chunk_id, score, raw_score, rank from (query_id, variant_id, chunk_id, rank, score, n_lists).

    A list without a chunk adds nothing; the score is the sum of 1 / (60 + rank) by the number of lists, 1 at most."""
    summed = ranked.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (K_RRF + F.col("rank"))).alias("sum"), F.max("score").alias("raw_score"), F.max(n_lists).alias("n"))
    return top_k(summed.select("query_id", "chunk_id", F.least(F.lit(1.0), F.col("sum") / F.col("n")).alias("score"), "raw_score"), k, digits=9)


def _both(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    left = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    right = sparse.select("query_id", "chunk_id", F.col("norm_score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    return left.join(right, ["query_id", "chunk_id"], "full_outer")


_rows = ("query_id", "chunk_id", "score", "rank", "dense_score", "bm25_score", "dense_rank", "bm25_rank")


def _finished(fused: DataFrame, k: int) -> DataFrame:
    filled = fused.withColumns({"dense_score": F.coalesce("dense_score", F.lit(0.0)), "bm25_score": F.coalesce("bm25_score", F.lit(0.0))})
    filled = filled.withColumns({"dense_rank": F.coalesce("dense_rank", F.lit(NO_RANK)), "bm25_rank": F.coalesce("bm25_rank", F.lit(NO_RANK))})
    return top_k(filled, k, digits=9).select(*_rows)


def hybrid_rrf(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """Fuses by rank; a list without a chunk ranks it at its own length + 60. Scores go up to 1."""
    at = W.partitionBy("query_id")
    both = _both(dense, sparse).withColumns({"n_dense": F.count("dense_rank").over(at), "n_bm25": F.count("bm25_rank").over(at)})
    part = lambda side: 1.0 / (K_RRF + F.coalesce(F.col(f"{side}_rank"), F.col(f"n_{side}") + K_RRF))
    return _finished(both.withColumn("score", F.least(F.lit(1.0), (part("dense") + part("bm25")) / (2.0 / (K_RRF + 1)))), k)


def hybrid_linear(dense: DataFrame, sparse: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Fuses by score: weight for the dense side, the rest for the other; a missing score is 0."""
    score = weight * F.coalesce("dense_score", F.lit(0.0)) + (1 - weight) * F.coalesce("bm25_score", F.lit(0.0))
    return _finished(_both(dense, sparse).withColumn("score", score), k)
