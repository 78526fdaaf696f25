"""Reranking of pairs of query and passage behind one interface."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessella.operators.bm25 import terms, top_k


class PairScorer(Protocol):
    """A model that scores pairs; its raw scores go through a sigmoid."""

    def score(self, queries: list[str], texts: list[str]) -> list[float]: ...


def _sigmoid(x):
    return 1.0 / (1.0 + F.exp(-x))


#: Pairs that a model scores at once.
BATCH_PAIRS = 64


def rerank_by_model(candidates: DataFrame, scorer: PairScorer | Callable[[], PairScorer], top_n: int) -> DataFrame:
    """candidates (query_id, query, chunk_id, text, rank) with cross_encoder_score and their new rank.

    scorer is a model or, better, a function that loads one: it is called once in each Python worker, and its model stays there. A query for which the model can't be loaded
    or fails, or gives no number, keeps its first top_n candidates in their order, without a score."""
    load = scorer if isinstance(scorer, type) or not hasattr(scorer, "score") else lambda: scorer

    def predictor():
        try:
            model = load()
        except Exception as error:  # noqa: BLE001  (whatever a model raises)
            logging.getLogger(__name__).warning("the reranker can't be loaded: %s", error)
            return lambda queries, texts: np.full(len(queries), np.nan)

        def run(queries: np.ndarray, texts: np.ndarray) -> np.ndarray:
            try:
                return np.asarray(model.score(list(queries), list(texts)), np.float64)
            except Exception as error:  # noqa: BLE001
                logging.getLogger(__name__).warning("the reranker failed: %s", error)
                return np.full(len(queries), np.nan)

        return run

    run = predict_batch_udf(predictor, return_type=DoubleType(), batch_size=BATCH_PAIRS)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = candidates.withColumn("__raw", run(text("query"), text("text")))
    failed = F.max(F.col("__raw").isNull() | F.isnan("__raw")).over(W.partitionBy("query_id"))
    scored = raw.withColumn("__failed", failed).withColumn("cross_encoder_score", F.when(~F.col("__failed"), _sigmoid(F.col("__raw"))))
    best = scored.withColumnRenamed("rank", "__rank").withColumn("__best", F.when(F.col("__failed"), -F.col("__rank").cast("double")).otherwise(F.col("cross_encoder_score")))
    kept = top_k(best, top_n, best="__best")
    return kept.withColumn("cross_encoder_score", F.when(~F.col("__failed"), F.col("__best"))).drop("__raw", "__failed", "__rank", "__best")


def rerank_by_overlap(candidates: DataFrame, top_n: int) -> DataFrame:
    """A lexical stand-in, no neural model: the share of the query's distinct terms that the passage holds, centred, through a sigmoid."""
    wanted = F.array_distinct(terms(F.col("query")))
    share = F.size(F.array_intersect(wanted, terms(F.col("text")))) / F.greatest(F.lit(1), F.size(wanted))
    scored = candidates.drop("rank").withColumn("cross_encoder_score", _sigmoid(8.0 * share - 4.0))
    return top_k(scored, top_n, best="cross_encoder_score")


Reranker = Callable[[DataFrame, int], DataFrame]


def reranker(enabled: bool = True, scorer: PairScorer | Callable[[], PairScorer] | None = None) -> Reranker:
    """A function of candidates and how many to keep: by the model, else by overlap; disabled, in their order."""
    if not enabled:
        return no_rerank
    return (lambda rows, n: rerank_by_model(rows, scorer, n)) if scorer else rerank_by_overlap


def no_rerank(candidates: DataFrame, top_n: int) -> DataFrame:
    return candidates.where(F.col("rank") <= top_n)
