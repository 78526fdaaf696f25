"""Streaming ingest: documents that arrive as Parquet files are cleaned and cut as in batch, and added to an index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions.text import preprocess
from tessella.operators import bm25
from tessella.operators.chunking import chunked


def stream_chunks(spark: SparkSession, folder: str, schema: StructType, size: int = 512, overlap: int = 64) -> DataFrame:
    """A stream of chunks; every step works on a row alone, so that there is no state."""
    docs = spark.readStream.schema(schema).parquet(folder)
    return chunked(docs.withColumn("text", preprocess(F.col("text"))), size, overlap)


def write_chunks(chunks: DataFrame, path: str, checkpoint: str):
    """Appends the chunks to a Parquet table, each file once, and ends when no new file is there."""
    return chunks.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def add_batch(chunks: DataFrame, path: str, batch: int) -> None:
    """Adds chunks (chunk_id, text, ...) to an index: their postings and lengths in segments of their own, the df of their terms, their totals.

    Each table has a folder for each batch, which is replaced if the batch comes again: after a failure it counts once. What the
    index holds already is neither read nor written."""
    spark = chunks.sparkSession

    def saved(df: DataFrame, name: str) -> DataFrame:
        at = f"{path}/{name}/batch={batch}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    kept = saved(chunks, "chunks")
    made = saved(bm25.segmented(kept.select("chunk_id", "text"), kept.count()), "segments")
    saved(bm25.totals_of(made), "totals")
    saved(bm25.blocks_of(made).groupBy("term").agg(F.sum("n").alias("df")), "df")


def index_stream(spark: SparkSession, folder: str, schema: StructType, path: str, checkpoint: str, size: int = 512, overlap: int = 64, files_at_once: int = 1_000):
    """Adds every document (doc_id, source, text) that arrives in a folder to the index at path, and ends when no new file is there."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    chunks = chunked(docs.withColumn("text", preprocess(F.col("text"))), size, overlap)
    return chunks.writeStream.foreachBatch(lambda rows, batch: add_batch(rows, path, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_index(spark: SparkSession, path: str, save=lambda df, name: df) -> bm25.Bm25Index:
    """The index of all batches there are. Segments stand as they were written; only df and totals are summed. A chunk id that came in two batches stands for two chunks."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    # segments are numbered within a batch
    made = read("segments").withColumn("segment", F.col("batch").cast("long") * (1 << 32) + F.col("segment")).drop("batch")
    totals = save(read("totals").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_terms").alias("n_terms")), "totals")
    df = read("df").groupBy("term").agg(F.sum("df").alias("df"))
    return bm25.Bm25Index(bm25.blocks_of(made), bm25.lengths_of(made), save(bm25.stats_of(df, totals.head()["n_chunks"]), "stats"), totals)
