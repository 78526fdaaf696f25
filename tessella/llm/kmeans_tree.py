"""Approximate nearest neighbours by a hierarchical k-means tree.

A tree of k-means clusterings is fitted on a bounded sample; every vector is sent down to a leaf. A query
walks the tree best bin first: a priority queue holds the branches not yet taken by their distance to the
query, and gives the leaves one by one. How many leaves a query visits is widened until the recall measured
for calibration queries, against brute force over all rows, reaches the target. Vectors of the visited
leaves are compared with the query in double precision.

The tree grows with the table: a leaf that holds more than full_leaf rows is split by a tree of its own,
fitted where a bounded sample of its rows lies, until no leaf is full or the tree, which is sent as a broadcast, has most_leaves
leaves. Leaves that lie side by side are packed into blocks of at most piece rows; a larger leaf, and many queries
of one block, are cut into pieces of bounded size. A query goes once to every block that holds a leaf it visits; each block
gives its k nearest for a query, and these are merged. A query visits leaves until they hold k rows beside itself.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
neither do those, among rows and queries, whose length is not the most frequent one of the rows (the smaller of two as frequent); rows with the
query's own id are not its candidates; repeated rows are candidates each; ties go to the smaller id; fewer
candidates than k are all returned; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.scratch import Scratch


@dataclass(frozen=True)
class TreeParams:
    """sample_rows: most vectors that the tree is fitted on; leaf_rows: a node of the sample with fewer is a leaf; calibration:
    queries for which recall is measured; recall: what it must reach; piece: most rows or queries that one group holds; full_leaf: rows from
    which a leaf is split; sub_sample: most rows that it is split by; most_leaves: a bound of the tree."""

    sample_rows: int = 16_384
    branching: int = 8
    leaf_rows: int = 64
    calibration: int = 64
    recall: float = 0.98
    piece: int = 4_096
    full_leaf: int = 16_384
    sub_sample: int = 2_048
    most_leaves: int = 65_536
    seed: int = 5


class KMeansTree:
    """Nodes hold the centres of their children; a child is a node or, negative, a leaf (~child is its number)."""

    def __init__(self, vectors: np.ndarray, params: TreeParams):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.random = np.random.default_rng(params.seed)
        self.root = self._build(vectors, params)
        del self.random

    def _leaf(self) -> int:
        self.leaves += 1
        return ~(self.leaves - 1)

    def _build(self, x: np.ndarray, params: TreeParams) -> int:
        if len(x) <= params.leaf_rows:
            return self._leaf()
        centres, own = self._cluster(x, params.branching)
        used = np.unique(own)
        if len(used) < 2:
            return self._leaf()
        at = len(self.centres)
        self.centres.append(centres[used])
        self.children.append([])
        self.children[at] = [self._build(x[own == c], params) for c in used]
        return at

    def _cluster(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        distinct = x[self.random.permutation(len(x))[: 8 * k]]
        centres = distinct[:1]
        while len(centres) < min(k, len(distinct)):  # far points first
            away = _squares(distinct, centres).min(1)
            if away.max() <= 0:
                break
            centres = np.r_[centres, distinct[[int(away.argmax())]]]
        for _ in range(12):
            own = _squares(x, centres).argmin(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            counts = np.bincount(own, minlength=len(centres))[:, None]
            moved = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
            if np.allclose(moved, centres):
                break
            centres = moved
        return centres, _squares(x, centres).argmin(1)

    def graft(self, leaf: int, sub: KMeansTree) -> None:
        """Puts a tree in a leaf's place; its first leaf keeps the number, the others get new ones."""
        base, names = len(self.centres), [leaf, *range(self.leaves, self.leaves + sub.leaves - 1)]
        moved = lambda c: c + base if c >= 0 else ~names[~c]
        root = moved(sub.root)
        for children in self.children:
            children[:] = [root if c == ~leaf else c for c in children]
        self.root = root if self.root == ~leaf else self.root
        self.centres += sub.centres
        self.children += [[moved(c) for c in children] for children in sub.children]
        self.leaves += sub.leaves - 1

    def in_order(self) -> list[int]:
        """The leaves from left to right."""
        out, work = [], [self.root]
        while work:
            node = work.pop()
            if node < 0:
                out.append(~node)
            else:
                work += reversed(self.children[node])
        return out

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        out = np.empty(len(x), np.int64)
        work = [(self.root, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if node < 0:
                out[rows] = ~node
                continue
            own = _squares(x[rows], self.centres[node]).argmin(1)
            work += [(child, part) for c, child in enumerate(self.children[node]) if len(part := rows[own == c])]
        return out

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, the most promising first."""
        queue = [(0.0, 0, self.root)]
        count = 0
        while queue:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                yield ~node
                continue
            for d, child in zip(_squares(q[None], self.centres[node])[0], self.children[node], strict=True):
                count += 1
                heapq.heappush(queue, (float(d), count, child))


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding."""
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def valid(vectors: DataFrame, id_col: str, vector_col: str, width: int | None = None) -> tuple[DataFrame, int | None]:
    """id and v (in its own type) of the vectors that take part, and their length; None without any."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & v.isNotNull()).where(F.size("v") > 0).where(F.coalesce(fine, F.lit(False)))
    if width is None:
        sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
        width = sizes[0]["n"] if sizes else None
    return rows.where(F.size("v") == (width or 0)), width


def nearest(block: np.ndarray, ids: np.ndarray, q: np.ndarray, q_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest rows of block to q, ties to smaller ids, without rows of q's own id."""
    diff = block - q
    distance = np.sqrt((diff * diff).sum(1))
    distance[ids == q_id] = np.inf
    if len(ids) > 4 * k:
        cut = np.partition(distance, k)[k]
        near = np.flatnonzero(distance <= cut)
    else:
        near = np.arange(len(ids))
    order = near[np.lexsort((ids[near], distance[near]))][:k]
    order = order[np.isfinite(distance[order])]
    return ids[order], distance[order]


def true_neighbours(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """query, id, score: the k nearest of all rows for a bounded set of queries, by brute force in blocks of rows."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _matrix(batch.column("v")), batch.column("id").to_numpy()
            found = [nearest(x, own, q[i], q_ids[i], k) for i in range(len(q))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query", "id", "score"]
            )

    return top(rows.mapInArrow(run, "query long, id long, score double"), k)


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank; equal (query, id) pairs of different rows all count."""
    order = W.partitionBy("query").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrated(tree: KMeansTree, rows: DataFrame, sample: tuple[np.ndarray, np.ndarray], k: int, params: TreeParams) -> tuple[int, float]:
    """The least number of leaves for which calibration queries (of the sample) reach the recall, and that recall."""
    ids, vectors = sample[0][: params.calibration], sample[1][: params.calibration]
    truth = true_neighbours(rows, ids, vectors, k)
    truth = truth.join(F.broadcast(rows.sparkSession.createDataFrame([(int(i),) for i in np.unique(ids)], "query long")), "query")
    pairs = truth.join(rows.select("id", "v"), "id").select("query", "v").toArrow()
    if not pairs.num_rows:
        return tree.leaves, 1.0
    leaves = tree.leaf_of(_matrix(pairs.column("v").combine_chunks()))
    by_id = {int(i): list(tree.best_first(v)) for i, v in zip(ids, vectors, strict=True)}
    place = {i: {leaf: n for n, leaf in enumerate(order)} for i, order in by_id.items()}
    ranks = np.sort([place[q][leaf] for q, leaf in zip(pairs.column("query").to_pylist(), leaves.tolist(), strict=True)])
    wanted = int(np.ceil(params.recall * len(ranks))) - 1
    visits = int(ranks[wanted]) + 1
    return visits, float((ranks < visits).mean())


def leafed(rows: DataFrame, tree: KMeansTree) -> DataFrame:
    """rows (id, v) with their leaf."""
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            leaf = own.leaf_of(_matrix(batch.column("v"))) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(leaf.astype(np.int32))], ["id", "v", "leaf"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], rows.schema["v"], T.StructField("leaf", T.IntegerType())]))


def grown(rows: DataFrame, tree: KMeansTree, params: TreeParams, scratch: Scratch) -> tuple[DataFrame, dict[int, int]]:
    """The indexed rows (id, v, leaf) and how many each leaf holds, after full leaves of the tree were split."""
    seed, turn, stuck = params.seed, 0, set()

    def fit(key: tuple, part: pa.Table) -> pa.Table:
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int32()), "tree": [pickle.dumps(KMeansTree(_matrix(part.column("v").combine_chunks()), params))]})

    while True:
        indexed = scratch.save(leafed(rows, tree), f"index{turn}")
        counts = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # a row for each leaf of the tree
        full = [leaf for leaf, n in counts.items() if n > params.full_leaf and leaf not in stuck]
        if not full or tree.leaves >= params.most_leaves:
            return indexed, counts
        of_full = indexed.join(F.broadcast(indexed.sparkSession.createDataFrame([(x,) for x in full], "leaf int")), "leaf")
        first = of_full.withColumn("n", F.row_number().over(W.partitionBy("leaf").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))).where(F.col("n") <= params.sub_sample)
        for r in first.select("leaf", "v").groupBy("leaf").applyInArrow(fit, "leaf int, tree binary").toLocalIterator():
            sub = pickle.loads(r["tree"])
            if sub.leaves > 1 and tree.leaves < params.most_leaves:
                tree.graft(r["leaf"], sub)
            else:
                stuck.add(r["leaf"])
        if len(stuck.intersection(full)) == len(full):
            return indexed, counts
        if turn:
            scratch.drop(f"index{turn - 1}")
        turn += 1


def packed(order: list[int], counts: dict[int, int], piece: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each leaf, and how many pieces each block is cut into."""
    block_of, pieces, held = np.zeros(max(order) + 1, np.int64), [1], 0
    for leaf in order:
        n = counts.get(leaf, 0)
        if held and held + n > piece:
            pieces.append(1)
            held = 0
        block_of[leaf] = len(pieces) - 1
        held += n
        pieces[-1] = max(1, -(-held // piece))
    return block_of, np.array(pieces)


def nearest_of(asked: np.ndarray, ids: np.ndarray, visits: list, block: np.ndarray, block_ids: np.ndarray, leaf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, id and distance of the k nearest rows of a block for each of its queries, among the leaves that the query visits."""
    numbers, local = np.unique(leaf, return_inverse=True)
    found, step = [], max(1, 2_000_000 // max(1, len(block)))
    for at in range(0, len(asked), step):
        q, own = asked[at : at + step], ids[at : at + step]
        open_ = np.zeros((len(q), len(numbers)), bool)
        for i, leaves in enumerate(visits[at : at + step]):
            open_[i] = np.isin(numbers, leaves)
        away = _squares(q, block)
        away[~open_[:, local] | (own[:, None] == block_ids)] = np.inf
        last = min(k, len(block)) - 1
        cut = np.partition(away, last, axis=1)[:, last]
        # what rounding may have moved is measured exactly, too
        rows, columns = np.nonzero((away <= cut[:, None] + 1e-9 * (1 + (q * q).sum(1))[:, None]) & np.isfinite(away))
        diff = block[columns] - q[rows]
        distance = np.sqrt((diff * diff).sum(1))
        order = np.lexsort((block_ids[columns], distance, rows))
        rows, columns, distance = rows[order], columns[order], distance[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        found.append((own[rows[best]], block_ids[columns[best]], distance[best]))
    return tuple(np.concatenate([f[n] for f in found]) if found else np.empty(0, t) for n, t in enumerate((np.int64, np.int64, float)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, params: TreeParams = TreeParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for each row of queries (columns as in vectors)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "tree")
    rows, width = valid(vectors, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    drawn = rows.orderBy(F.xxhash64(F.lit(params.seed), "id"), "id").limit(params.sample_rows).toArrow()
    sample = drawn.column("id").to_numpy(), _matrix(drawn.column("v").combine_chunks())
    tree = KMeansTree(sample[1], params)
    indexed, counts = grown(rows, tree, params, scratch)
    visits, _ = calibrated(tree, indexed, sample, k, params)
    block_of, pieces = packed(tree.in_order(), counts, params.piece)
    sent = spark.sparkContext.broadcast(pickle.dumps((tree, block_of, counts)))
    asked, _ = valid(queries, id_col, vector_col, width)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, blocks, sizes = pickle.loads(sent.value)
        for batch in batches:
            at, places, leaves = [], [], []
            for i, q in enumerate(_matrix(batch.column("v")) if batch.num_rows else ()):
                visited, held = [], 0
                for leaf in own.best_first(q):
                    if len(visited) >= visits and held > k:
                        break
                    visited.append(leaf)
                    held += sizes.get(leaf, 0)
                visited = np.array(visited)
                for block in np.unique(blocks[visited]):
                    at.append(i)
                    places.append(block)
                    leaves.append(visited[blocks[visited] == block])
            take = pa.array(at, pa.int32())
            made = [batch.column("id").take(take), batch.column("v").take(take), pa.array(places, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(made, ["id", "v", "block", "leaves"])

    types = T.StructType([T.StructField("id", T.LongType()), asked.schema["v"], T.StructField("block", T.IntegerType()), T.StructField("leaves", T.ArrayType(T.IntegerType()))])
    visiting = scratch.save(asked.mapInArrow(walked, types), "visits")
    # both tables have a row for each leaf or block of the tree at most
    of_leaf = F.broadcast(spark.createDataFrame([(int(x), int(block_of[x]), int(pieces[block_of[x]])) for x in counts], "leaf int, block int, pieces int"))
    of_block = visiting.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / params.piece).cast("int").alias("q_pieces"))
    cut = F.broadcast(of_block.join(F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(pieces)], "block int, pieces int")), "block"))
    salt = lambda c, n: F.pmod(F.xxhash64(F.lit(11), c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visiting.join(cut, "block").withColumn("q_piece", salt("id", "q_pieces")).select("block", "q_piece", "id", "v", "leaves", each("pieces").alias("piece"))
    right = indexed.join(of_leaf, "leaf").withColumn("piece", salt("id", "pieces")).join(F.broadcast(of_block), "block").select("block", "piece", "id", "v", "leaf", each("q_pieces").alias("q_piece"))
    keys = ["block", "piece", "q_piece"]

    def compared(questions: pa.Table, there: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if questions.num_rows and there.num_rows:
            q, x = (_matrix(t.column("v").combine_chunks()) for t in (questions, there))
            found = nearest_of(q, questions.column("id").to_numpy(), questions.column("leaves").to_pylist(), x, there.column("id").to_numpy(), there.column("leaf").to_numpy(), k)
        return pa.table(dict(zip(("query", "id", "score"), found, strict=True)))

    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(compared, "query long, id long, score double")
    return top(found, k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
