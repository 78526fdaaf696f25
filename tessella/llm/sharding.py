"""Sharding by extendible hashing, with DataFrame functions only.

A directory of hash prefixes says which shard a document belongs to. It begins with one bucket; only
buckets over the byte limit split on another bit of the hash, until every bucket fits. Bytes are summed
by prefix before they are shuffled, so that the levels of the directory cost small aggregations, and
only documents of oversized buckets are looked at again when the directory needs more bits.

Defined cases: a null text has 0 bytes and a null id its own hash; an empty table has no shards; equal
ids with different texts have different hashes; a document over the limit is a shard of its own, with
fits false, and so are rows equal in id and text that are over it together (no hash tells them apart);
other columns of the input are kept, and those named like a result are replaced."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.scratch import Scratch

#: Bits of the hash: what fits a positive long in any engine.
BITS = 60
#: Bits that a further round of counting adds for the buckets that need it.
ROUND_BITS = 8
#: A level of the directory of at most so many entries (a few MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ENTRIES = 100_000
RESULTS = ("shard_depth", "shard_prefix", "shard_bytes", "shard_docs", "fits")


def hash_bits(key: str = "doc_id", text: str = "text") -> Column:
    """The first 60 bits of the MD5 of id and text, as a long."""
    joined = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits: int) -> Column:
    return F.shiftright("__hash", BITS - bits)


def directory(sizes: DataFrame, byte_limit: int, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """Levels of the directory: (bits, entries). Entries: __at (a prefix of that many bits) and RESULTS of its bucket.

    sizes: __hash and __bytes of each document. Each round sums bytes by a number of bits and rolls the
    sums up to every depth between; a bucket is final at the first depth where it fits. What doesn't fit
    at the last depth goes on to the next round."""
    total = sizes.agg(F.sum("__bytes")).head()[0] or 0
    start, end = 0, min(BITS, max(2, math.ceil(math.log2(max(1, total / byte_limit))) + 3))
    levels: list[tuple[int, DataFrame]] = []
    while True:
        fine = sizes.groupBy(_prefix(end).alias("__fine")).agg(F.sum("__bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        fine = scratch.save(fine, f"fine{end}")
        depths = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("__fine", end - d).alias("prefix")) for d in range(start, end + 1)]))
        nodes = fine.select("bytes", "docs", depths.alias("at")).groupBy("at.depth", "at.prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        settled = (F.col("bytes") <= byte_limit) | (F.col("docs") <= 1)
        if end == BITS:
            settled = settled | (F.col("depth") == BITS)
        nodes = scratch.save(nodes.withColumn("settled", settled), f"nodes{end}")
        parents = nodes.where(~F.col("settled")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        new = nodes.where("settled").withColumn("parent", F.shiftright("prefix", 1))
        below = new.where(F.col("depth") > start).join(parents, ["depth", "parent"], "left_semi").select(nodes.columns)
        final = below.unionByName(new.where(F.col("depth") == start).drop("parent"))
        spread = F.expr(f"explode(sequence(shiftleft(prefix, {end} - depth), shiftleft(prefix + 1, {end} - depth) - 1))")
        entries = final.select(
            F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), F.col("bytes").alias("shard_bytes"),
            F.col("docs").alias("shard_docs"), (F.col("bytes") <= byte_limit).alias("fits"), spread.alias("__at"),
        )
        levels.append((end, scratch.save(entries.join(fine.select(F.col("__fine").alias("__at")), "__at", "left_semi"), f"level{end}")))
        rest = nodes.where(~F.col("settled") & (F.col("depth") == end)).select(F.col("prefix").alias("__open"))
        if not rest.head(1):
            return levels
        sizes = scratch.save(sizes.withColumn("__open", _prefix(end)).join(rest, "__open", "left_semi").drop("__open"), f"open{end}")
        start, end = end, min(BITS, end + ROUND_BITS)


def sharded(docs: DataFrame, byte_limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes and RESULTS; shard_depth and shard_prefix name a shard."""
    scratch = Scratch(docs.sparkSession, "shards")
    names = [c for c in docs.columns if c not in {*RESULTS, "n_bytes"}]
    # the input's columns travel in one struct, so that none clashes with those used here
    carried = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    out = docs.select(carried, hash_bits(key, text).alias("__hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    sizes = scratch.save(out.select("__hash", F.col("n_bytes").alias("__bytes")), "sizes")
    found = None
    for bits, entries in directory(sizes, byte_limit, scratch):
        own = entries.select(F.col("__at").alias(f"__at{bits}"), F.struct(*RESULTS).alias(f"__entry{bits}"))
        small = own.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
        out = out.withColumn(f"__at{bits}", _prefix(bits)).join(F.broadcast(own) if small else own, f"__at{bits}", "left")
        found = F.col(f"__entry{bits}") if found is None else F.coalesce(found, F.col(f"__entry{bits}"))
    return out.withColumn("__entry", found).select(*[F.col("row").getField(c).alias(c) for c in names], "n_bytes", *[F.col(f"__entry.{c}").alias(c) for c in RESULTS])


def write_shards(docs: DataFrame, byte_limit: int, path: str) -> None:
    """Writes each shard's documents under its own folder; rows of a shard meet in one task."""
    named = sharded(docs, byte_limit).withColumn("shard", F.concat_ws("-", "shard_depth", "shard_prefix"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)


#: The same rows in DuckDB: bytes by prefix at every depth, and each document's first depth that fits.
ORACLE_SQL = """
WITH hashed AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
steps AS (SELECT doc_id, n_bytes, d, (h >> (60 - d)) AS p FROM hashed, (SELECT unnest(range(0, 41))::INTEGER AS d)),
nodes AS (SELECT d AS depth, p AS prefix, sum(n_bytes)::BIGINT AS bytes, count(*)::BIGINT AS docs FROM steps GROUP BY 1, 2),
paths AS (SELECT s.doc_id, s.n_bytes, n.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY n.depth) AS k
    FROM steps s JOIN nodes n ON n.depth = s.d AND n.prefix = s.p WHERE n.bytes <= {limit} OR n.docs <= 1)
SELECT doc_id, n_bytes, depth::INTEGER AS shard_depth, prefix AS shard_prefix, bytes AS shard_bytes, docs AS shard_docs, bytes <= {limit} AS fits
FROM paths WHERE k = 1
"""
