"""Token counts by an exact histogram of encoded lengths.

Documents are aggregated by their length in tokens; suffix and prefix sums over the histogram answer
totals, quantiles and truncated totals for every context limit without touching the documents again.

Defined cases: null and empty texts have length 0 and are counted; no documents give an empty
histogram; equal rows count once each, and documents of equal length share a row; a very long text is encoded
whole and has a length of its own; other columns of the input are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import bpe
from tessella.plans.scratch import Scratch


def histogram(lengths: DataFrame, length: str = "n_tokens", by: list[str] | None = None) -> DataFrame:
    """by, encoded_len, n_docs: one row for each length that occurs. Counts are combined before they are shuffled."""
    return lengths.groupBy(*(by or []), F.col(length).cast("long").alias("encoded_len")).agg(F.count(F.lit(1)).alias("n_docs"))


def with_sums(hist: DataFrame, by: list[str] | None = None, block: int = 256) -> DataFrame:
    """Adds, for each length taken as a context limit: docs_within and tokens_within (documents no longer than it), docs_over
    and tokens_over (longer ones), truncated_tokens (all documents cut at the limit), quantile (docs_within / all).

    The running sums go through blocks of lengths, so that no task sees a whole large histogram at once."""
    by = by or []
    at = F.floor(F.col("encoded_len") / block)
    rows = hist.withColumn("__block", at).withColumn("__tokens", F.col("encoded_len") * F.col("n_docs"))
    blocks = rows.groupBy(*by, "__block").agg(F.sum("n_docs").alias("__d"), F.sum("__tokens").alias("__t"))
    everything = W.partitionBy(*by)
    before = everything.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)

    def earlier(c: str) -> Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    blocks = blocks.select(*by, "__block", earlier("__d").alias("__d0"), earlier("__t").alias("__t0"), F.sum("__d").over(everything).alias("__dn"), F.sum("__t").over(everything).alias("__tn"))
    within = W.partitionBy(*by, "__block").orderBy("encoded_len").rowsBetween(W.unboundedPreceding, 0)
    joined = rows.join(blocks, [*by, "__block"]).select(
        *by, "encoded_len", "n_docs", "__dn", "__tn",
        (F.col("__d0") + F.sum("n_docs").over(within)).alias("docs_within"), (F.col("__t0") + F.sum("__tokens").over(within)).alias("tokens_within"),
    )
    over = F.col("__dn") - F.col("docs_within")
    return joined.select(
        *by, "encoded_len", "n_docs", "docs_within", "tokens_within", over.alias("docs_over"), (F.col("__tn") - F.col("tokens_within")).alias("tokens_over"),
        (F.col("tokens_within") + F.col("encoded_len") * over).alias("truncated_tokens"), (F.col("docs_within") / F.col("__dn")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: docs_within, docs_over, truncated_tokens; from the histogram alone, in one pass."""
    spark = sums.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context_limit long"))
    short = F.col("encoded_len") <= F.col("context_limit")
    return sums.crossJoin(wanted).groupBy("context_limit").agg(
        F.coalesce(F.sum(F.when(short, F.col("n_docs"))), F.lit(0)).alias("docs_within"),
        F.coalesce(F.sum(F.when(~short, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        F.sum(F.least("encoded_len", "context_limit") * F.col("n_docs")).alias("truncated_tokens"),
    )


def quantiles(sums: DataFrame, of: list[float]) -> DataFrame:
    """For each q: the smallest length that at least q of all documents don't exceed."""
    wanted = F.broadcast(sums.sparkSession.createDataFrame([(float(x),) for x in of], "q double"))
    return sums.crossJoin(wanted).where(F.col("quantile") >= F.col("q")).groupBy("q").agg(F.min("encoded_len").alias("encoded_len"))


def token_counts(docs: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """The histogram of docs' encoded lengths under a tokenizer file, with its sums.

    The histogram is saved, since the sums read it twice: each document is encoded once."""
    by = by or []
    found = Scratch(docs.sparkSession, "lengths").save(histogram(bpe.lengths(docs, path, by), by=by), "histogram")
    return with_sums(found, by)
