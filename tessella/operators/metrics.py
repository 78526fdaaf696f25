"""Retrieval metrics for all queries at once.

Input: hits (query_id, rank from 1, score, is_rel) and n_rel (query_id, n_rel)."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 3, 5)


def _ideal(k: int) -> Column:
    """The discounted gain of as many relevant rows as there can be among the first k."""
    n = F.least(F.lit(k), F.col("n_rel"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))).otherwise(0.0)


def query_metrics(hits: DataFrame, n_rel: DataFrame, ks: tuple[int, ...] = KS, by: tuple[str, ...] = (), digits: int = 4) -> DataFrame:
    """One row for each query (and by): precision, recall, hit_rate, ap, ndcg and semantic_score at each k, and mrr."""
    keys = ["query_id", *by]
    running = W.partitionBy(*keys).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rel = F.col("is_rel").cast("int")
    rows = hits.withColumn("hits_so_far", F.sum(rel).over(running))
    sums = [F.coalesce(1.0 / F.min(F.when(F.col("is_rel"), F.col("rank"))), F.lit(0.0)).alias("mrr"), F.max("rank").alias("n")]
    for k in ks:
        within = F.col("rank") <= k
        sums += [
            F.sum(F.when(within, rel).otherwise(0)).alias(f"h{k}"),
            F.sum(F.when(within & F.col("is_rel"), F.col("hits_so_far") / F.col("rank")).otherwise(0.0)).alias(f"ap{k}"),
            F.sum(F.when(within & F.col("is_rel"), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg{k}"),
            F.avg(F.when(within, F.col("score"))).alias(f"sem{k}"),
        ]
    rows = rows.groupBy(*keys).agg(*sums).join(n_rel, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = [*keys, F.bround("mrr", digits).alias("mrr")]
    for k in ks:
        made = {
            "precision": F.col(f"h{k}") / k,
            "recall": rate(F.col(f"h{k}"), F.col("n_rel")),
            "hit_rate": (F.col(f"h{k}") > 0).cast("double"),
            "ap": rate(F.col(f"ap{k}"), F.least(F.col("n_rel"), F.lit(k))),
            "ndcg": rate(F.col(f"dcg{k}"), _ideal(k)),
            "semantic_score": F.coalesce(F.col(f"sem{k}"), F.lit(0.0)),
        }
        out += [F.bround(v, digits).alias(f"{name}_at_{k}") for name, v in made.items()]
    return rows.select(*out)


def long_form(wide: DataFrame, keys: tuple[str, ...] = ("query_id", "strategy"), others: tuple[str, ...] = ("seconds", "latency")) -> DataFrame:
    """keys, metric, value."""
    return wide.unpivot([c for c in keys if c in wide.columns], [c for c in wide.columns if c not in (*keys, *others)], "metric", "value")


def mean_metrics(long: DataFrame, by: tuple[str, ...] = ("strategy",), digits: int = 4) -> DataFrame:
    return long.groupBy(*by, "metric").agg(F.bround(F.avg("value"), digits).alias("mean_value"))


def compare(means: DataFrame, a: str, b: str) -> DataFrame:
    """metric, value_a, value_b, delta, improvement_percent (null where a is not positive); a missing metric counts as 0."""
    left = means.where(F.col("strategy") == a).select("metric", F.col("mean_value").alias("value_a"))
    right = means.where(F.col("strategy") == b).select("metric", F.col("mean_value").alias("value_b"))
    both = left.join(right, "metric", "full_outer").select("metric", F.coalesce("value_a", F.lit(0.0)).alias("value_a"), F.coalesce("value_b", F.lit(0.0)).alias("value_b"))
    delta = F.col("value_b") - F.col("value_a")
    return both.withColumns({"delta": F.bround(delta, 4), "improvement_percent": F.when(F.col("value_a") > 0, F.bround(delta / F.col("value_a") * 100, 1))})


def win_loss_tie(wide: DataFrame, a: str, b: str, metric: str = "mrr") -> DataFrame:
    """wins_a, wins_b, ties over queries."""
    left = wide.where(F.col("strategy") == a).select("query_id", F.col(metric).alias("x"))
    both = left.join(wide.where(F.col("strategy") == b).select("query_id", F.col(metric).alias("y")), "query_id")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return both.agg(count(F.col("x") > F.col("y")).alias("wins_a"), count(F.col("y") > F.col("x")).alias("wins_b"), count(F.col("x") == F.col("y")).alias("ties"))


def verdict(delta: Column) -> Column:
    """A word for a change of MRR."""
    return F.when(delta > 0.1, "strong improvement").when(delta > 0, "slight improvement").when(delta < -0.05, "decline").otherwise("comparable")


#: So many queries' keywords are one automaton, which is sent to all tasks; more are dealt, as blocks, to blocks of chunks.
BANK_BLOCK = 5_000
#: Chunks that one group of a bank of several blocks holds, about.
CHUNK_BLOCK = 20_000


class KeywordAutomaton:
    """Which queries' keywords a text holds: one pass over the text for all keywords (Aho-Corasick)."""

    def __init__(self, keywords: dict[str, list[int]]):
        self.everywhere = set(keywords.get("", ()))
        self.found = ahocorasick.Automaton()
        for word, rows in keywords.items():
            if word:
                self.found.add_word(word, tuple(rows))
        if len(self.found):
            self.found.make_automaton()

    @classmethod
    def of(cls, bank: pa.Table) -> KeywordAutomaton:
        """From a bank's column keywords; a query is known by its row."""
        rows: dict[str, list[int]] = {}
        for i, words in enumerate(bank.column("keywords").to_pylist()):
            for word in set(words or ()):
                if word is not None:
                    rows.setdefault(word, []).append(i)
        return cls(rows)

    def rows_of(self, text: str) -> list[int]:
        hit = set(self.everywhere)
        if len(self.found):
            for _, rows in self.found.iter(text):
                hit.update(rows)
        return sorted(hit)

    def pairs(self, chunks: pa.Table | pa.RecordBatch, bank: pa.Table) -> pa.RecordBatch:
        at, who = [], []
        for i, text in enumerate(chunks.column("low").to_pylist()):
            rows = self.rows_of(text) if text is not None else ()
            who += rows
            at += [i] * len(rows)
        ids, asked = chunks.column("chunk_id"), bank.column("query_id")
        plain = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        return pa.RecordBatch.from_arrays([plain(asked).take(pa.array(who, pa.int64())), plain(ids).take(pa.array(at, pa.int64()))], ["query_id", "chunk_id"])


def keyword_relevance(chunks: DataFrame, bank: DataFrame) -> DataFrame:
    """query_id, chunk_id of the chunks that hold a keyword of a query, whatever its case; an empty keyword is in every text, a null one in none.

    A bank (query_id, keywords) of one block is sent to the chunks where they lie. A larger one is cut into blocks, and each meets each block of
    chunks in a task of its own."""
    rows = bank.select("query_id", F.transform("keywords", F.lower).alias("keywords"))
    texts = chunks.select("chunk_id", F.lower("text").alias("low"))
    schema = f"query_id {rows.schema['query_id'].dataType.simpleString()}, chunk_id {texts.schema['chunk_id'].dataType.simpleString()}"
    whole = rows.limit(BANK_BLOCK + 1).toArrow()
    if whole.num_rows <= BANK_BLOCK:
        sent = chunks.sparkSession.sparkContext.broadcast(whole)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = KeywordAutomaton.of(sent.value)
            for batch in batches:
                yield automaton.pairs(batch, sent.value)

        return texts.mapInArrow(run, schema)
    n_bank, n_chunks = -(-rows.count() // BANK_BLOCK), max(1, -(-texts.count() // CHUNK_BLOCK))
    dealt = lambda column, n: F.pmod(F.xxhash64(F.lit(3), column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("query_id", "keywords", dealt("query_id", n_bank).alias("bank_block"), every(n_chunks).alias("chunk_block"))
    right = texts.select("chunk_id", "low", dealt("chunk_id", n_chunks).alias("chunk_block"), every(n_bank).alias("bank_block"))

    def met(mine: pa.Table, there: pa.Table) -> pa.Table:
        return pa.Table.from_batches([KeywordAutomaton.of(mine).pairs(there, mine)])

    return left.groupBy("bank_block", "chunk_block").cogroup(right.groupBy("bank_block", "chunk_block")).applyInArrow(met, schema)


def ground_truth(relevant: DataFrame, fallback: DataFrame) -> DataFrame:
    """relevant (query_id, chunk_id), and for queries without any the first of fallback's ranked hits."""
    first = fallback.where("rank = 1").select("query_id", "chunk_id")
    return relevant.unionByName(first.join(relevant.select("query_id").distinct(), "query_id", "left_anti"))


def judged(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """hits with is_rel."""
    marked = hits.join(relevant.withColumn("is_rel", F.lit(True)), ["query_id", "chunk_id"], "left")
    return marked.withColumn("is_rel", F.coalesce("is_rel", F.lit(False)))


def summary(means: DataFrame, wins: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row of text: what changed from a to b in the mean reciprocal rank, the wins and a verdict."""
    mrr = compare(means, a, b).where("metric = 'mrr'")
    delta = F.col("value_b") - F.col("value_a")
    text = F.format_string(f"MRR {a} %.4f, {b} %.4f (%+.4f): %s; wins {a} %d, {b} %d, ties %d", "value_a", "value_b", delta, verdict(delta), "wins_a", "wins_b", "ties")
    return mrr.crossJoin(F.broadcast(wins)).select(verdict(delta).alias("verdict"), text.alias("summary"))  # one row each


def latency_profile(rows: DataFrame, value: str, by: str) -> DataFrame:
    """n, mean, standard deviation and 95th percentile for each by."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("std_value"), F.percentile(value, F.lit(0.95)).alias("p95_value"))
