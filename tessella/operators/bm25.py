"""BM25 over chunks: index tables, scores of whole batches of queries, top k by block maxima.

Postings lie in blocks, one for each term and segment of chunks, with what bounds the largest of each. A search first sums the maxima of a
query's terms, which bounds what any chunk of a segment can score, and reads the postings of those segments only that can hold one of the k best."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.plans.scratch import Scratch

#: Words that are no terms.
STOPWORDS = (
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did "
    "will would could should may might shall this that these those it its as if"
).split()
K1, B, FLOOR = 1.5, 0.75, 0.25


def terms(text: Column) -> Column:
    """Words of a text in lower case, without stopwords and words of one or two characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.filter(words, lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 2))


#: Chunks of a document that lie side by side form a segment of so many; so do so many chunks of short documents, about.
SEGMENT_CHUNKS = 64
#: A table of query terms, or of pairs of a query and a segment, of at most so many rows (some MB) is broadcast.
BROADCAST_TERMS = 200_000
#: Segments of each query, those with the highest bounds, that give the first k-th score.
FIRST_SEGMENTS = 4
#: Block maxima are worth their jobs from so many postings on, and for queries of so many terms on average: those of many terms add up to
#: bounds that hardly any segment misses. Other batches are summed in full, with the same result.
PRUNED_POSTINGS = 20_000_000
PRUNED_TERMS = 8
#: A task puts whole segments of about so many bytes of text into blocks at once.
TASK_BYTES = 2 << 20
#: A batch of queries of at most so many terms, and with at most a hundred times as many best scores, is sent to the tasks that sum (some MB).
TERMS_IN_TASKS = 50_000
#: What rounding to six digits may add to a score.
ROUNDING = 1e-6


@dataclass(frozen=True)
class Bm25Index:
    """blocks (segment, term, n, most_tf, least_dl, postings array of (chunk_id, tf, dl)), lengths (chunk_id, segment, dl), stats (term, df, idf) and totals (n_chunks, n_terms).

    A block holds the postings of a term in one segment of chunks, with the largest frequency and the smallest length among them. Nothing in a
    block depends on other chunks, so that blocks of a new batch of chunks stand beside those there are."""

    blocks: DataFrame
    lengths: DataFrame
    stats: DataFrame
    totals: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def average(self) -> float:
        """The average length of a chunk."""
        row = self.totals.head()
        return (row["n_terms"] or 0) / max(1, row["n_chunks"])


TABLES = tuple(f.name for f in fields(Bm25Index))


def part(tf: Column | np.ndarray, dl: Column | np.ndarray, average: float) -> Column | np.ndarray:
    """What a posting adds to a score for each unit of idf: it rises with tf and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (average or 1.0)))


def counted_terms(listed: Column) -> Column:
    """An array of (term, tf) from an array of terms, within the row: the terms are sorted, and a term's count is the distance to the next."""
    ends = lambda s: F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, at: F.transform(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda i, j: F.struct(F.get(s, i).alias("term"), (F.get(at, j + 1) - i).alias("tf")))
    # each value is named once, so that it is not computed again for every term
    named = F.transform(F.array(F.array_sort(listed)), lambda s: F.transform(F.array(ends(s)), lambda at: runs(s, at)))
    return F.element_at(F.element_at(named, 1), 1)


def _segment(n_segments: int) -> Column:
    """Neighbouring chunks of a document share a segment, as their terms are alike."""
    number = F.coalesce(F.try_to_number(F.regexp_extract("chunk_id", r"_chunk_(\d{1,9})$", 1), F.lit("999999999")), F.lit(0))
    group = (number / SEGMENT_CHUNKS).cast("int")
    return F.pmod(F.xxhash64(F.substring_index("chunk_id", "_chunk_", 1), group), F.lit(n_segments)).cast("long")


def _coded_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What terms() finds in texts in lower case, for a whole batch: the row and the code of each term, and the distinct terms by code."""
    words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"[^\p{L}\p{N}_]+", " "))
    coded = words.flatten().dictionary_encode()
    is_term = pc.and_not(pc.greater(pc.utf8_length(coded.dictionary), 2), pc.is_in(coded.dictionary, pa.array(STOPWORDS)))
    codes = coded.indices.to_numpy().astype(np.int64)
    kept = is_term.to_numpy(zero_copy_only=False).astype(bool)[codes]
    return np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())[kept], codes[kept], coded.dictionary


def _rows(segment: np.ndarray, term: pa.Array, n_terms: pa.Array, starts: np.ndarray, chunk_id: pa.Array, tf: np.ndarray, dl: np.ndarray) -> pa.RecordBatch:
    """One row for each run of postings that begins at one of starts."""
    postings = pa.StructArray.from_arrays([chunk_id, pa.array(tf, pa.int32()), pa.array(dl, pa.int32())], ["chunk_id", "tf", "dl"])
    ends = np.r_[starts, len(tf)]
    columns = {
        "segment": pa.array(segment), "term": term, "n": pa.array(np.diff(ends), pa.int64()),
        "most_tf": pa.array(np.maximum.reduceat(tf, starts), pa.int32()), "least_dl": pa.array(np.minimum.reduceat(dl, starts), pa.int32()),
        "n_terms": n_terms, "postings": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), postings),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _blocks(segment: np.ndarray, chunk_id: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of segmented() for whole segments; rows are in the order of their segments."""
    row, code, words = _coded_terms(texts)
    dl = np.bincount(row, minlength=len(texts))
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    yield _rows(segment[starts], pa.nulls(len(starts), pa.string()), pa.array(np.add.reduceat(dl, starts), pa.int64()), starts, chunk_id, np.zeros(len(dl), np.int64), dl)
    if not len(row):
        return
    many = len(words)
    met, tf = np.unique(row * many + code, return_counts=True)
    row, code = met // many, met % many
    place = np.cumsum(np.r_[0, segment[1:] != segment[:-1]])[row] * many + code
    order = np.argsort(place, kind="stable")
    place, row, code, tf = place[order], row[order], code[order], tf[order]
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    yield _rows(segment[row[starts]], words.take(pa.array(code[starts])), pa.nulls(len(starts), pa.int64()), starts, chunk_id.take(pa.array(row)), tf, dl[row])


def segmented(chunks: DataFrame, n_chunks: int) -> DataFrame:
    """The blocks of chunks (chunk_id, text), and for each segment a row without a term: all its chunks with their lengths, and n_terms, the sum of these.

    Texts, which are smaller than lists of their terms, are shuffled once, by segment; tasks find the terms of a few segments at a time. A null
    text is empty."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    used = chunks.select(_segment(-(-max(1, n_chunks) // SEGMENT_CHUNKS)).alias("segment"), "chunk_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
            one = table.combine_chunks().to_batches()[0]
            return _blocks(one.column("segment").to_numpy(), one.column("chunk_id"), one.column("text"))

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= TASK_BYTES:
                table = pa.Table.from_batches(held)
                segment = table.column("segment").to_numpy()
                whole = int(segment.searchsorted(segment[-1]))  # the last segment may go on
                if whole:
                    yield from made(table.slice(0, whole))
                    held = table.slice(whole).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield from made(table)

    schema = f"segment long, term string, n long, most_tf int, least_dl int, n_terms long, postings array<struct<chunk_id:{kind},tf:int,dl:int>>"
    return used.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, schema)


def blocks_of(made: DataFrame) -> DataFrame:
    return made.where("term is not null").drop("n_terms")


def lengths_of(made: DataFrame) -> DataFrame:
    return made.where("term is null").select("segment", F.explode("postings").alias("p")).select("p.chunk_id", "segment", "p.dl")


def totals_of(made: DataFrame) -> DataFrame:
    """n_chunks and n_terms, without reading postings."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return made.where("term is null").agg(total("n").alias("n_chunks"), total("n_terms").alias("n_terms"))


def stats_of(df: DataFrame, n_chunks: int) -> DataFrame:
    """term, df, idf of (term, df): idf is ln((N - df + 0.5) / (df + 0.5)); where negative, a quarter of the mean over all terms stands for it."""
    raw = df.select("term", "df", F.log((F.lit(n_chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def index(chunks: DataFrame, save=lambda df, name: df) -> Bm25Index:
    """The index of chunks (chunk_id, text), which are read twice: they are counted first. save(df, name) may write a table that is read often and return it."""
    n_chunks = chunks.count()
    made = save(segmented(chunks, n_chunks), "segments")
    stats = save(stats_of(blocks_of(made).groupBy("term").agg(F.sum("n").alias("df")), n_chunks), "stats")
    return Bm25Index(blocks_of(made), lengths_of(made), stats, save(totals_of(made), "totals"))


def weighed(idx: Bm25Index, queries: DataFrame) -> DataFrame:
    """query_id, term, df, weight of the terms of queries (query_id, query). A repeated term counts again."""
    wanted = queries.select("query_id", F.explode(counted_terms(terms(F.col("query")))).alias("c")).groupBy("query_id", F.col("c.term").alias("term")).agg(F.sum("c.tf").alias("qtf"))
    return wanted.join(idx.stats, "term").select("query_id", "term", "df", (F.col("qtf") * F.col("idf")).alias("weight"))


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows, counted, are few."""
    return F.broadcast(df) if df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else df


def _summed(hits: DataFrame, average: float) -> DataFrame:
    """Scores of chunks from (segment, query_id, weight, postings); a chunk lies in one segment."""
    each = hits.select("segment", "query_id", "weight", F.explode("postings").alias("p"))
    added = F.col("weight") * part(F.col("p.tf"), F.col("p.dl"), average)
    return each.groupBy("segment", "query_id", F.col("p.chunk_id").alias("chunk_id")).agg(F.sum(added).alias("score")).drop("segment")


def scores(idx: Bm25Index, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, score for all chunks that share a term with a query (query_id, query): the full sum."""
    return _all_scores(idx, weighed(idx, queries))


def _all_scores(idx: Bm25Index, asked: DataFrame) -> DataFrame:
    """Blocks of the terms asked for are shuffled by segment before they meet the queries, so that sums stay in their task, however many queries share a term."""
    asked = _few(asked)
    met = idx.blocks.select("segment", "term", "postings").join(_few(asked.select("term").distinct()), "term", "left_semi").repartition("segment")
    return _summed(met.join(asked, "term"), idx.average())


def bounds(idx: Bm25Index, asked: DataFrame) -> DataFrame:
    """query_id, segment, bound, n: the most that a chunk of a segment can score, and the postings that it would take to know; postings are not read."""
    tops = idx.blocks.select("segment", "term", "n", part(F.col("most_tf"), F.col("least_dl"), idx.average()).alias("top"))
    return tops.join(asked, "term").groupBy("query_id", "segment").agg(F.sum(F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))).alias("bound"), F.sum("n").alias("n"))


def likely_scores(idx: Bm25Index, queries: DataFrame, k: int) -> DataFrame:
    """Scores among which each query's k best are: by block maxima where that saves reading, else in full."""
    save = Scratch(queries.sparkSession, "bm25").save
    asked = save(weighed(idx, queries), "asked")
    size = asked.agg(F.sum("df").alias("postings"), F.count(F.lit(1)).alias("rows"), F.count_distinct("query_id").alias("queries")).head()
    if (size["postings"] or 0) > PRUNED_POSTINGS and size["rows"] <= PRUNED_TERMS * size["queries"]:
        return _by_maxima(idx, asked, k, save)[0]
    if 0 < size["rows"] <= TERMS_IN_TASKS and size["queries"] * k <= 100 * TERMS_IN_TASKS:
        return _best_in_tasks(idx, asked, k)
    return _all_scores(idx, asked)


def _best_in_tasks(idx: Bm25Index, asked: DataFrame, k: int) -> DataFrame:
    """Scores among which each query's k best are: a task sums segment after segment and writes what reaches the k-th score that it has met.

    asked has at most TERMS_IN_TASKS rows and is sent to all tasks; blocks of its terms are shuffled by segment, as for the full sums."""
    kinds = {"query_id": asked.schema["query_id"].dataType.simpleString(), "chunk_id": idx.lengths.schema["chunk_id"].dataType.simpleString()}
    rows = asked.select("query_id", "term", "weight").toArrow()
    coded = [rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("query_id", "term")]
    query, code = (c.indices.to_numpy().astype(np.int64) for c in coded)
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(coded[1].dictionary) + 1))
    sent = asked.sparkSession.sparkContext.broadcast((coded[0].dictionary, coded[1].dictionary, starts, query[order], rows.column("weight").to_numpy()[order]))
    average = idx.average()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, starts, query, weight = sent.value
        best = np.full((len(ids), k), -np.inf)

        def summed(block: pa.RecordBatch) -> pa.RecordBatch:
            """The hits of one segment's blocks."""
            nonlocal best
            postings, count = block.column("postings").flatten(), block.column("postings").value_lengths().to_numpy()
            tf, dl = (postings.field(c).to_numpy().astype(float) for c in ("tf", "dl"))
            chunks = postings.field("chunk_id").dictionary_encode(null_encoding="encode")
            n = len(chunks.dictionary)
            term = np.repeat(pc.index_in(block.column("term"), words).to_numpy(), count)
            # every posting meets the queries that ask for its term
            many = starts[term + 1] - starts[term]
            pair = np.arange(many.sum()) + np.repeat(starts[term] - np.r_[0, np.cumsum(many)[:-1]], many)
            place = query[pair] * n + np.repeat(chunks.indices.to_numpy(), many)
            score = np.bincount(place, weight[pair] * np.repeat(part(tf, dl, average), many), len(ids) * n).reshape(-1, n)
            score[np.bincount(place, minlength=len(ids) * n).reshape(-1, n) == 0] = -np.inf
            best = np.partition(np.hstack([best, score]), -k, axis=1)[:, -k:]
            q, c = np.nonzero((score > -np.inf) & (score >= best[:, :1] - 2 * ROUNDING))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), chunks.dictionary.take(pa.array(c)), pa.array(score[q, c])], ["query_id", "chunk_id", "score"])

        held = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()
            if not table:
                continue
            segment = table[0].column("segment").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist()]
            yield from (summed(table[0].slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False))
            held = [table[0].slice(cuts[-1])]  # the last segment may go on
        yield from map(summed, held)

    wanted = _few(asked.select("term").distinct())
    met = idx.blocks.select("segment", "term", "postings").join(wanted, "term", "left_semi").select("segment", "term", "postings")
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    return met.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, schema)


def best_scores(idx: Bm25Index, queries: DataFrame, k: int, save=None) -> tuple[DataFrame, DataFrame]:
    """Scores (query_id, chunk_id, score) among which each query's k best are, and the pairs (query_id, segment, n) whose postings were read.

    A query's few segments with the highest bounds are summed first; then only those whose bound reaches the k-th score found. save writes a
    table that is read often; without it, one is written to the shared folder."""
    save = save or Scratch(queries.sparkSession, "bm25").save
    return _by_maxima(idx, save(weighed(idx, queries), "asked"), k, save)


def _by_maxima(idx: Bm25Index, asked: DataFrame, k: int, save) -> tuple[DataFrame, DataFrame]:
    asked = _few(asked)
    average = idx.average()
    limits = save(bounds(idx, asked).withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "segment"))), "bounds")

    def summed(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("query_id", "segment").join(asked, "query_id").select("query_id", "segment", "term", "weight")
        return _summed(idx.blocks.select("segment", "term", "postings").join(_few(wanted), ["segment", "term"]), average)

    first = save(summed(limits.where(F.col("place") <= FIRST_SEGMENTS)), "first")
    last = top_k(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    open_ = limits.where(F.col("place") > FIRST_SEGMENTS).join(_few(last), "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - ROUNDING))
    rest = save(open_.select("query_id", "segment", "n"), "open")
    return first.unionByName(summed(rest)), limits.where(F.col("place") <= FIRST_SEGMENTS).select("query_id", "segment", "n").unionByName(rest)


def top_k(scored: DataFrame, k: int, best: str = "score", tie: str = "chunk_id", digits: int = 6) -> DataFrame:
    """The k best rows of each query with their rank; equal scores (to so many digits) by id."""
    order = W.partitionBy("query_id").orderBy(F.desc("__s"), tie)
    rows = scored.withColumn("__s", F.round(best, digits))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn(best, F.col("__s")).drop("__s")


def normalised(ranked: DataFrame, score: str = "score") -> DataFrame:
    """Scores by the query's best score; by 1 where that is not positive."""
    best = F.max(score).over(W.partitionBy("query_id"))
    return ranked.withColumn("norm_score", F.col(score) / F.when(best > 0, best).otherwise(F.lit(1.0)))


def search(idx: Bm25Index, queries: DataFrame, k: int = 5, include_zero: bool = False) -> DataFrame:
    """query_id, chunk_id, score, rank, norm_score. include_zero fills a query's list up with chunks that match none of its terms, by id.

    Only a query with fewer than k matches is filled up, and its list holds all of them: of the first 2 k chunks by id,
    k are not in it."""
    found = top_k(likely_scores(idx, queries, k), k)
    if include_zero:
        some = idx.lengths.select("chunk_id").orderBy("chunk_id").limit(2 * k)
        # a list shorter than k holds every match of its query
        short = queries.select("query_id").join(found.groupBy("query_id").count(), "query_id", "left").where(F.coalesce("count", F.lit(0)) < k).select("query_id")
        fill = short.crossJoin(F.broadcast(some)).join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        found = top_k(found.drop("rank").unionByName(fill.withColumn("score", F.lit(0.0))), k)
    return normalised(found)
