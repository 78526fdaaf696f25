"""Exact top-k inner products by the threshold algorithm over sorted lists.

Rows and queries are dealt into blocks of bounded size, and every block of rows meets every block of queries in one task: a stated
set of queries against all rows. A block sorts its rows once by each dimension. A query reads the lists of its dimensions from the
end that its sign prefers, in growing steps; every row it meets is scored at once by all its components. What no list has shown yet
scores at most the sum of the query's components times the next value of each list. The query stops as soon as that bound is below its k-th score. The block's
k best rows are merged with those of other blocks.

The lists are read in steps, each as deep as all before it and three times more. Once they have shown half of a block's rows, the others are scored with one
product of matrices instead of being looked up one by one; that reads more rows, never fewer.

Scores are integers and exact: components are floor(scale * x) in double precision; products are summed as doubles only where no sum can
pass 53 bits, else as integers of any size, kept within 64 bits at the end.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; a query meets the vectors of its own
length; rows with the query's own id are not its candidates; repeated rows are candidates each, and repeated queries have a list each; ties go to
the smaller id, null ids last; fewer candidates than k are all returned; an empty table gives an empty result; other columns are ignored, whatever their names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most rows and queries of a block.
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 1_024
#: Depth of the lists after the first step, and what it grows by.
FIRST_DEPTH = 4
DEEPER = 4
#: Queries that hold a score for each row of a block at once.
AT_ONCE = 128
EXACT = float(1 << 53)
LAST = np.iinfo(np.int64).max


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """at (a number of the row), id, v (doubles) and width of the vectors that take part."""
    v = F.col(f"`{vector_col}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) > 0) & fine)
    return kept.select(F.monotonically_increasing_id().alias("at"), "id", "v", F.size("v").alias("width"))


def components(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x), a row for each vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.floor(np.clip(scale * flat, -most, most)).reshape(len(column), -1)


class SortedLists:
    """Rows of one block by the values of each dimension, ascending."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        self.order = np.argsort(x, axis=0, kind="stable").T
        self.values = np.take_along_axis(x.T, self.order, axis=1)

    def heads(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows at places begin to end of all lists, from the largest value down and from the smallest up."""
        return self.order[:, self.n - end : self.n - begin], self.order[:, begin:end]

    def threshold(self, q: np.ndarray, depth: int) -> np.ndarray:
        """The most that a row scores which no list has shown down to that depth."""
        return np.maximum(q, 0) @ self.values[:, self.n - 1 - depth] + np.minimum(q, 0) @ self.values[:, depth]


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query: by score, then order."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        there = np.flatnonzero(scores >= cut)
    else:
        there = np.arange(len(scores))
    return there[np.lexsort((order[there], -scores[there]))[:k]]


def _exactly(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products as integers of any size, kept within 64 bits."""
    whole = np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)
    return np.array([max(-LAST - 1, min(LAST, int(s))) for s in whole @ np.array([int(c) for c in q], object)], object)


def block_top_k(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every query its k best rows of the block: places of queries, places of rows, scores. seen gets the number of rows scored for each query."""
    n, lists = len(x), SortedLists(x)
    # the row of each id's order, so that ties are cut in the order of ids
    order = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    exact = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < EXACT
    if not exact:
        for i, one in enumerate(q):
            others = np.flatnonzero(ids != q_ids[i])
            scores = _exactly(x[others], one)
            best = sorted(range(len(others)), key=lambda j: (-scores[j], order[others[j]]))[:k]  # noqa: B023
            out.append((np.full(len(best), i), others[best], scores[best].astype(np.int64)))
            if seen is not None:
                seen.append(n)
    for start in range(0, len(q) if exact else 0, AT_ONCE):
        part, own = q[start : start + AT_ONCE], q_ids[start : start + AT_ONCE]
        met = np.zeros((len(part), n), bool)
        scores = np.full((len(part), n), -np.inf)
        open_, depth = np.arange(len(part)), 0
        while len(open_):
            deeper = min(n, max(FIRST_DEPTH, DEEPER * depth))
            high, low = lists.heads(depth, deeper)
            bound = lists.threshold(part[open_], deeper) if deeper < n else np.full(len(open_), -np.inf)
            still = []
            for b, most in zip(open_, bound, strict=True):
                one = part[b]
                up, down = one > 0, one < 0
                now = np.zeros(n, bool)
                now[high[up].ravel()] = True
                now[low[down].ravel()] = True
                now &= ~met[b]
                new = np.flatnonzero(now)
                met[b, new] = True
                scores[b, new] = x[new] @ one
                there = scores[b][met[b] & (ids != own[b])]
                if not (len(there) >= k and np.partition(there, len(there) - k)[len(there) - k] > most):
                    still.append(b)
            open_, depth = np.array(still, int), deeper
            full = met[open_].sum(1) * 2 >= n if deeper < n else np.ones(len(open_), bool)
            if full.any():
                scores[open_[full]] = part[open_[full]] @ x.T
                met[open_[full]] = True
                open_ = open_[~full]
        for b in range(len(part)):
            there = np.flatnonzero(met[b] & (ids != own[b]))
            best = there[_best(scores[b, there], order[there], k)]
            out.append((np.full(len(best), start + b), best, scores[b, best].astype(np.int64)))
            if seen is not None:
                seen.append(int(met[b].sum()))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest inner product for each row of queries (columns as in vectors)."""
    rows, asked = valid(vectors, id_col, vector_col), valid(queries, id_col, vector_col)
    # a row for each length of vectors
    counted = lambda df, most, name: df.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    sizes = counted(rows, BLOCK_ROWS, "n_rows").join(counted(asked, BLOCK_QUERIES, "n_asked"), "width")
    dealt = lambda df, n: df.join(sizes, "width").withColumn("own", F.pmod(F.xxhash64(F.lit(13), "at"), F.col(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt(asked, "n_asked").select("width", F.col("own").alias("asked"), "at", "id", "v", every("n_rows").alias("block"))
    right = dealt(rows, "n_rows").select("width", F.col("own").alias("block"), "id", "v", every("n_asked").alias("asked"))
    keys = ["width", "block", "asked"]

    def compared(questions: pa.Table, there: pa.Table) -> pa.Table:
        names = ["at", "query_id", "vec_id", "score"]
        if not questions.num_rows or not there.num_rows:
            return pa.table(dict(zip(names, [pa.array([], pa.int64())] * 4, strict=True)))
        q_ids, ids = (t.column("id").combine_chunks() for t in (questions, there))
        numbers = ids.fill_null(LAST).to_numpy()
        # a null id is nobody's own
        q, x = (components(t.column("v").combine_chunks(), scale) for t in (questions, there))
        own = q_ids.fill_null(-LAST - 1).to_numpy()
        at, found, scores = block_top_k(own, q, numbers, x, k)
        return pa.table([questions.column("at").combine_chunks().take(pa.array(at)), q_ids.take(pa.array(at)), ids.take(pa.array(found)), pa.array(scores, pa.int64())], names)

    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(compared, "at long, query_id long, vec_id long, score long")
    best = W.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
