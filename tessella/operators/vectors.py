"""Vector normalisation, exact top-k search and an inverted-file index.

Vectors that are null, empty, or hold null or non-finite components take no part; a query meets the vectors
of its own length."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.bm25 import top_k
from tessella.plans.scratch import Scratch

#: So many queries (some MB) are sent to all tasks at once; more meet the vectors in pairs of blocks.
BLOCK_QUERIES = 4_096
#: Most rows of a block of vectors, and most cells of a matrix of scores.
BLOCK_ROWS = 16_384
SCORE_CELLS = 1_000_000
#: So many texts are embedded and compared at once.
SLICE_TEXTS = 2_048
METRICS = ("cosine", "inner_product", "euclidean", "squared_euclidean")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalised(v: Column) -> Column:
    """v by its length; a zero vector stays."""
    length = F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return F.transform(v, lambda x: x.cast("double") / length)


def usable(rows: DataFrame, key: str) -> DataFrame:
    """key, embedding (doubles) and its length of the vectors that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(key, v.cast("array<double>").alias("embedding")).where(v.isNotNull() & (F.size(v) > 0) & fine)
    return kept.withColumn("width", F.size("embedding"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1)
    return x / np.where(length == 0, 1, length)[:, None]


def _rounded(scores: np.ndarray, digits: int = 6) -> np.ndarray:
    """As Spark rounds: half up, of the shortest decimal number that stands for a double."""
    values, back = np.unique(scores, return_inverse=True)
    step = Decimal(1).scaleb(-digits)
    return np.array([float(Decimal(repr(float(v))).quantize(step, ROUND_HALF_UP)) for v in values])[back]


def _places(ids: pa.Array) -> np.ndarray:
    """The place of each id in Spark's order."""
    place = np.empty(len(ids), np.int64)
    place[pa.compute.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return place


class _Comparison:
    """The k best rows for each query, k at most: by their score to six digits, then by id, as the merge orders them."""

    def __init__(self, k: int, metric: str, other_ids: bool):
        self.k, self.metric, self.other_ids = k, metric, other_ids

    def _cut(self, at_q: np.ndarray, at_x: np.ndarray, score: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which of the candidates of all queries stay."""
        counts = np.bincount(at_q)
        crowded = counts[at_q] > self.k
        if not crowded.any():
            return np.arange(len(at_q))
        rows = np.flatnonzero(crowded)
        rows = rows[np.lexsort((place[at_x[rows]], -_rounded(score[rows]), at_q[rows]))]
        heads = np.flatnonzero(np.r_[True, np.diff(at_q[rows]) != 0])
        within = np.arange(len(rows)) - np.repeat(heads, np.diff(np.r_[heads, len(rows)]))
        return np.r_[np.flatnonzero(~crowded), rows[within < self.k]]

    def kept(self, asked: pa.Array, found: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray | None]:
        """The k best of found for each query, and each query's last score among them, where it has k. asked: the queries' ids."""
        at_q = pa.compute.index_in(found.column("query_id"), asked).to_numpy(zero_copy_only=False).astype(np.int64)
        score = found.column("score").to_numpy()
        stay = self._cut(at_q, np.arange(len(score)), score, _places(found.column("vec_id")))
        least = np.full(len(asked), np.inf)
        np.minimum.at(least, at_q[stay], score[stay])
        least[np.bincount(at_q[stay], minlength=len(asked)) < self.k] = -np.inf
        return found.take(pa.array(stay)), least

    def __call__(self, q_ids: pa.Array, q: np.ndarray, ids: pa.Array, x: np.ndarray, least: np.ndarray | None = None) -> pa.RecordBatch:
        """least: scores that k rows of each query have reached already, so that rows far below can be left out."""
        plain, found = self.metric in ("inner_product", "cosine"), []
        if self.metric == "cosine":
            q, x = _unit(q), _unit(x)
        step = max(1, SCORE_CELLS // max(1, len(q)))
        q_names, names = (np.array(c.to_pylist()) for c in (q_ids, ids)) if self.other_ids else (None, None)
        place = _places(ids)
        for at in range(0, len(x) if len(q) else 0, step):
            part = x[at : at + step]
            score = q @ part.T if plain else 2 * q @ part.T - (q * q).sum(1)[:, None] - (part * part).sum(1)
            if self.other_ids:
                score[q_names[:, None] == names[None, at : at + step]] = -np.inf
            k = min(self.k, len(part))
            cut = least if least is not None and np.isfinite(least).all() else -np.partition(-score, k - 1, axis=1)[:, k - 1]
            # what rounding may have moved is measured exactly, too
            slack = 1e-6 if plain else 1e-5 * (1 + np.abs(cut)[:, None])
            at_q, at_x = np.nonzero((score >= cut[:, None] - slack) & np.isfinite(score))
            exact = score[at_q, at_x] if plain else -((part[at_x] - q[at_q]) ** 2).sum(1)
            exact = -np.sqrt(-exact) if self.metric == "euclidean" else exact
            stay = self._cut(at_q, at_x + at, exact, place)
            found.append((at_q[stay], at_x[stay] + at, exact[stay]))
        rows, columns, scores = (np.concatenate([f[n] for f in found]) if found else np.empty(0, t) for n, t in enumerate((int, int, float)))
        return pa.RecordBatch.from_arrays([q_ids.take(pa.array(rows)), ids.take(pa.array(columns)), pa.array(scores)], ["query_id", "vec_id", "score"])


def _types(rows: DataFrame, asked: DataFrame) -> str:
    return f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id {rows.schema['vec_id'].dataType.simpleString()}, score double"


def _blocks(n: Column, most: int, name: str) -> Column:
    return F.ceil(n / most).cast("int").alias(name)


def in_blocks(rows: DataFrame, asked: DataFrame, keys: list[str], few_keys: bool, compare: Callable, counted: DataFrame | None = None) -> DataFrame:
    """What compare() finds where rows (keys, vec_id, embedding) and queries (keys, query_id, embedding) have equal keys.

    A key's rows and its queries are cut into blocks of bounded size, and each block of one meets each of the other in a
    task of its own, so that no key is too large for one. counted (keys, n): the number of rows of each key, where it is known."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if counted is None else counted
    questions = asked.groupBy(*keys).agg(_blocks(F.count(F.lit(1)), BLOCK_QUERIES, "n_asked"))
    sizes = counted.where("n > 0").select(*keys, _blocks(F.col("n"), BLOCK_ROWS, "n_rows")).join(questions, keys)
    sizes = F.broadcast(sizes) if few_keys else sizes
    salt = lambda c, n: F.pmod(F.xxhash64(F.lit(11), c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, keys).withColumn("asked_block", salt("query_id", "n_asked")).select(*keys, "asked_block", "query_id", "embedding", each("n_rows").alias("block"))
    right = rows.join(sizes, keys).withColumn("block", salt("vec_id", "n_rows")).select(*keys, "block", "vec_id", "embedding", each("n_asked").alias("asked_block"))
    by = [*keys, "block", "asked_block"]

    def run(questions: pa.Table, there: pa.Table) -> pa.Table:
        if not questions.num_rows or not there.num_rows:
            return pa.table({"query_id": questions.column("query_id").slice(0, 0), "vec_id": there.column("vec_id").slice(0, 0), "score": pa.array([], pa.float64())})
        width = len(questions.column("embedding")[0])
        q, x = _matrix(questions.column("embedding"), width), _matrix(there.column("embedding"), width)
        return pa.Table.from_batches([compare(questions.column("query_id").combine_chunks(), q, there.column("vec_id").combine_chunks(), x)])

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, _types(rows, asked))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", other_ids: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank from vectors (vec_id, embedding) and queries (query_id, embedding).

    Tasks multiply matrices and keep their k best rows for a query, and these are merged. Queries are counted first: one block
    of them is sent to the vectors where they lie; more stay distributed, and blocks of both sides meet in tasks.
    (Squared) Euclidean scores are negative distances. With other_ids, a row with the query's own id is no answer."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    rows, asked = usable(vectors, "vec_id"), usable(queries, "query_id")
    compare = _Comparison(k, metric, other_ids)
    block = asked.limit(BLOCK_QUERIES + 1).toArrow()
    if block.num_rows > BLOCK_QUERIES:
        return top_k(in_blocks(rows, asked, ["width"], True, compare), k, tie="vec_id")
    sent = vectors.sparkSession.sparkContext.broadcast({w: block.filter(pa.compute.equal(block.column("width"), w)) for w in set(block.column("width").to_pylist())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, questions in sent.value.items():
                mine = batch.filter(pa.compute.equal(batch.column("width"), width))
                if mine.num_rows:
                    yield compare(questions.column("query_id").combine_chunks(), _matrix(questions.column("embedding"), width), mine.column("vec_id"), _matrix(mine.column("embedding"), width))

    return top_k(rows.mapInArrow(run, _types(rows, asked)), k, tie="vec_id")


def exact_top_k_of_texts(texts: DataFrame, queries: DataFrame, k: int, embed: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """query_id, vec_id, score (cosine), rank from texts (vec_id, text), which are embedded where they lie and compared at once: their vectors, several times
    as large, are neither written nor sent. queries (query_id, embedding): one block of them at most, or None is returned.

    embed() is called once in each task and gives a function from texts to their vectors. A task holds a slice of texts and the best so far of each query."""
    block = usable(queries, "query_id").limit(BLOCK_QUERIES + 1).toArrow()
    if block.num_rows > BLOCK_QUERIES:
        return None
    compare, step = _Comparison(k, "cosine", False), SLICE_TEXTS
    sent = texts.sparkSession.sparkContext.broadcast({w: block.filter(pa.compute.equal(block.column("width"), w)) for w in set(block.column("width").to_pylist())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, best, least = embed(), None, None
        asked = {w: (t.column("query_id").combine_chunks(), _matrix(t.column("embedding"), w)) for w, t in sent.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = np.asarray(model([t or "" for t in part.column("text").to_pylist()]), np.float64)
                fine = np.isfinite(x).all(axis=1)
                if x.shape[1] not in asked or not fine.any():
                    continue
                q_ids, q = asked[x.shape[1]]
                found = compare(q_ids, q, part.column("vec_id").filter(pa.array(fine)), x[fine], least)
                best = found if best is None else pa.Table.from_batches([best, found]).combine_chunks().to_batches()[0] if best.num_rows + found.num_rows else best
                best, least = compare.kept(q_ids, best)
        if best is not None:
            yield best

    return top_k(texts.select("vec_id", "text").mapInArrow(run, _types(texts, queries)), k, tie="vec_id")


def clipped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def fitted_centres(sample: DataFrame, n_cells: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centres of k-means over the vectors of a bounded sample (embedding)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = sample.select(array_to_vector(l2_normalised(F.col("embedding"))).alias("features"))
    return np.array(KMeans(k=n_cells, seed=seed, maxIter=rounds).fit(unit).clusterCenters())


def _nearest_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort((centres * centres).sum(1) - 2 * x @ centres.T, axis=1, kind="stable")[:, :n]


class InvertedFile:
    """A saved index: vectors (of length 1) in cells around centres that k-means finds on a bounded sample; a query looks at its n_probe nearest cells.

    Under path lie cells (cell, n, centre, id_type), a row for each cell, and rows (vec_id, embedding), a folder for each cell. A search joins the rows with the cells
    that its queries probe, a broadcast table of n_cells rows at most, so that Spark reads the folders of those cells only.
    load() takes an index as it lies there. With fewer vectors than cells there is one cell and the search is exact. Vectors of another length than
    most of the sample take no part."""

    def __init__(self, spark: SparkSession, path: str, n_probe: int = 10):
        self.spark, self.path, self.n_probe = spark, path.rstrip("/"), n_probe
        self.cells = spark.read.parquet(f"{self.path}/cells")
        found = self.cells.orderBy("cell").toArrow()  # n_cells rows
        self.n_cells = found.num_rows
        self.centres = np.array(found.column("centre").to_pylist(), np.float64).reshape(self.n_cells, -1)
        self.width = self.centres.shape[1]
        self.rows = spark.read.schema(f"vec_id {found.column('id_type')[0].as_py()}, embedding array<double>, cell int").parquet(f"{self.path}/rows")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, n_cells: int = 100, n_probe: int = 10, sample_rows: int = 20_000, seed: int = 7) -> InvertedFile:
        """Writes the index of vectors (vec_id, embedding) to path, in place of one that lies there."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        fine = usable(vectors, "vec_id")
        sample = fine.orderBy(F.xxhash64(F.lit(seed), "vec_id")).limit(sample_rows).cache()
        widths = sample.groupBy("width").count().orderBy(F.desc("count"), "width").head(1)
        width = widths[0]["width"] if widths else 1
        centres = fitted_centres(sample.where(F.col("width") == width), n_cells, seed) if widths and widths[0]["count"] >= n_cells else np.zeros((1, width))
        sample.unpersist()
        placed = with_cells(vectors, "vec_id", centres, 1).select("vec_id", "embedding", F.col("cells")[0].alias("cell"))
        # a cell of more than a block of rows is written by several tasks
        files = 1 + vectors.count() // len(centres) // BLOCK_ROWS
        dealt = placed.repartition("cell", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(files)))
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(f"{path}/rows")
        id_type = placed.schema["vec_id"].dataType.simpleString()
        written = spark.read.schema(f"vec_id {id_type}, cell int").parquet(f"{path}/rows")
        counted = {r["cell"]: r["count"] for r in written.groupBy("cell").count().collect()}  # a row for each cell
        cells = [(i, counted.get(i, 0), c.tolist(), id_type) for i, c in enumerate(centres)]
        spark.createDataFrame(cells, "cell int, n long, centre array<double>, id_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path, n_probe)

    def copy_to(self, path: str) -> None:
        """The same index under another path."""
        self.rows.repartition("cell", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 + self.cells.agg(F.max("n")).head()[0] // BLOCK_ROWS))).write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(f"{path}/rows")
        self.cells.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")

    def probed(self, queries: DataFrame) -> DataFrame:
        """query_id, embedding, cell: a row for each cell that a query looks at."""
        return with_cells(queries, "query_id", self.centres, self.n_probe).select("query_id", "embedding", F.explode("cells").alias("cell"))

    def search(self, queries: DataFrame, k: int, other_ids: bool = False) -> DataFrame:
        """query_id, vec_id, score (cosine), rank.

        One block of queries is sent to the rows of the cells that it probes, and only their folders are read. More queries stay
        distributed: the rows are joined with the probed cells, so that Spark prunes the folders as it runs, and blocks of both sides meet in tasks."""
        compare = _Comparison(k, "cosine", other_ids)
        block = usable(queries, "query_id").where(F.col("width") == self.width).limit(BLOCK_QUERIES + 1).toArrow()
        if block.num_rows > BLOCK_QUERIES:
            asked = Scratch(self.spark, "probed").save(self.probed(queries), "cells")
            return top_k(in_blocks(self.rows, asked, ["cell"], True, compare, self.cells.select("cell", "n")), k, tie="vec_id")
        x = _unit(_matrix(block.column("embedding"), self.width))
        near = _nearest_cells(x, self.centres, self.n_probe)
        ids, of_cell = block.column("query_id").combine_chunks(), {}
        for cell in np.unique(near).tolist():
            mine = np.flatnonzero((near == cell).any(1))
            of_cell[cell] = ids.take(pa.array(mine)), x[mine]
        sent, width = self.spark.sparkContext.broadcast(of_cell), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell in pa.compute.unique(batch.column("cell")).to_pylist():
                    mine = batch.filter(pa.compute.equal(batch.column("cell"), cell))
                    yield compare(*sent.value[cell], mine.column("vec_id"), _matrix(mine.column("embedding"), width))

        rows = self.rows.where(F.col("cell").isin(list(of_cell))).select("vec_id", "embedding", "cell")
        return top_k(rows.mapInArrow(run, _types(rows, queries)), k, tie="vec_id")


def with_cells(rows: DataFrame, key: str, centres: np.ndarray, n: int) -> DataFrame:
    """key, embedding (of length 1) and cells: the n nearest cells of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("embedding"), centres.shape[1]))
                cells = pa.FixedSizeListArray.from_arrays(pa.array(_nearest_cells(x, centres, n).ravel().astype(np.int32)), min(n, len(centres)))
                unit = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), centres.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(key), unit.cast(pa.list_(pa.float64())), cells.cast(pa.list_(pa.int32()))], [key, "embedding", "cells"])

    kept = usable(rows, key).where(F.col("width") == centres.shape[1]).drop("width")
    return kept.mapInArrow(run, f"{key} {kept.schema[key].dataType.simpleString()}, embedding array<double>, cells array<int>")


STORES = ("flat", "ivf")


def store(kind: str, vectors: DataFrame, n_cells: int = 100, n_probe: int = 10, path: str | None = None) -> DataFrame | InvertedFile:
    """What search_store() searches: the vectors themselves, or an inverted file over them, saved under path or else in the shared folder."""
    if kind not in STORES:
        raise ValueError(f"a store is one of {STORES}")
    return vectors if kind == "flat" else InvertedFile.build(vectors, path or Scratch(vectors.sparkSession, "cells").root, n_cells, n_probe)


def search_store(searched: DataFrame | InvertedFile, queries: DataFrame, k: int) -> DataFrame:
    return searched.search(queries, k) if isinstance(searched, InvertedFile) else exact_top_k(searched, queries, k)
