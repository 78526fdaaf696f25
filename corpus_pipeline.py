"""From documents to token ids: toxicity, quality rules, n-gram Jaccard join, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. All but the last
return the columns of documents; the mix repeats a document as often as it takes it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, mixing, ngram_jaccard, quality_rules, toxicity
from tessella.plans.scratch import Scratch
from tessella.plans.ship import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores below its threshold."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.trained(toxicity.labelled(docs, labels)))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed; n_chars follows the text."""
    ship(spark)
    kept = quality_rules.accepted(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    ship(spark)
    return ngram_jaccard.first_of_each(docs, n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shuffled within its shards."""
    ship(spark)
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token_ids, n_tokens, round_trip."""
    ship(spark)
    return bpe.encoded_and_checked(docs, bpe.vocabulary(), ["doc_id", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard", join_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs


#: A fitted classifier, a similarity join and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
