"""The registered queries of the corpus preparation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, class_lm, conversation_repair, html_text, kmeans_tree, mixing, ngram_jaccard, oracle, phrases, quality_rules, sharding, threshold_topk, token_counts, toxicity
from tessella.plans.ship import ship

SHARD_BYTES = 1 << 20
THRESHOLD_K, THRESHOLD_EVERY, THRESHOLD_SCALE = 5, 50, 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), bpe.vocabulary())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read(spark, sf_dir, "documents"), ["doc_id"], clean=False).drop("clean_text", "failed_rules")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return kmeans_tree.search(vectors, vectors.where("vec_id % 100 = 0"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(read(spark, sf_dir, "pages"), ["page_id", "url"])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(read(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)
    return rows.select("doc_id", "n_bytes", *sharding.RESULTS)


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.scored(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), bpe.vocabulary(), ["doc_id"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.trained(toxicity.labelled(docs, read(spark, sf_dir, "labels")))
    rows = docs.select("doc_id", toxicity.held_out().alias("held_out"), "text")
    return toxicity.scored(rows, model, ["doc_id", "held_out"])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(read(spark, sf_dir, "conversations"))
    return conversation_repair.summaries(conversation_repair.repaired(rows, there=F.col("there")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return threshold_topk.top_k(vectors, vectors.where(f"vec_id % {THRESHOLD_EVERY} = 0"), THRESHOLD_K, THRESHOLD_SCALE)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_mixing, op4_kmeans_tree, op5_ngram_jaccard, op6_html_text, op7_sharding, op8_class_lm, op9_bpe, op10_toxicity, op11_conversation_repair, op12_phrases, op13_threshold_topk)}

ORACLE_SQL = {"op2_quality_rules": oracle.quality(), "op5_ngram_jaccard": oracle.jaccard(3, 90, 100), "op7_sharding": sharding.ORACLE_SQL.format(limit=SHARD_BYTES), "op11_conversation_repair": oracle.REPAIR, "op12_phrases": oracle.collocations(30, 80, 2_000), "op13_threshold_topk": oracle.inner_top_k(THRESHOLD_K, THRESHOLD_EVERY, THRESHOLD_SCALE)}
