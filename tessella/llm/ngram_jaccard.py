"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word n-grams. Every n-gram's hash chooses a part of a bit sketch
and a bit in it, and flips that bit; so two documents' sketches differ in at most as many bits as their
sets differ in n-grams. Sets of sizes s <= t with Jaccard similarity p or more differ in at most
D = s (1 - p) / p n-grams: of D + 1 + r parts at least r + 1 are equal (pigeonhole). Sketches are made per
band of sizes, each band with the D of its largest s; the larger set of a pair is at most one band up, so
a document has the parts of its own band and of the band below. A part has 2^32 bits and is kept as the
XOR of a random word for each bit that is set.

Of its parts a document may leave out the r that most others share, in one order for all documents:
of the r + 1 that a similar document shares, the last in that order is left out by neither. Documents are
joined on the equal parts that remain, and pairs verified on whole sets: exact, with no cap on partners.

Equal sets are one node from the start. Within a group of nodes that share a part, not all pairs are
made: first each node is paired with a few leaders, and what is verified forms components. Then only
groups are left that still hold nodes of different components. Small ones give their pairs across
components; of large ones the nodes outside the largest component are compared with all others: tasks hold
block against block, and of these pairs only those are written whose sketches' Hamming distance allows the
similarity. A pair within a component can change no component, so no link is lost.

Every row of a part carries its set's size and a sketch of 128 bits. Of the pairs that share a part by chance, those whose
sizes or sketches rule the similarity out are never made: differing bits are differing n-grams, so no similar pair is among them.

Defined cases: lower case is of A-Z only; with fewer words than n the whole sequence is one n-gram; a
null text, or one without words, has an empty set and is its own component; documents of equal sets are
linked; rows that share an id each get the component of their own text; a row without an id gets the
smallest id that it is linked with, or null; ids are numbers (a string that is none stops the query with Spark's cast error); a very
long text is one set, whole; an empty table gives an empty result; other columns of the
input are ignored. Hashes of n-grams and of sets have 64 bits: two of n unequal ones meet with a chance
of n^2 / 2^65."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.texts import mixed, per_row, slices, split_words, unpacked, whole, word_hashes
from tessella.plans.scratch import Scratch

#: Bytes of text that a task takes on at once: words met in them are hashed once. More would save little time and cost memory.
SLICE_BYTES = 4 << 20
#: Shared keys are marked in 2^SLOT_BITS bits (16 MB).
SLOT_BITS = 27
#: So many ids (some MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Leaders that each node of a group is paired with first.
LEADERS = 4
#: A group of at most so many nodes gives its pairs across components by a join; a larger one is compared in blocks of BLOCK nodes.
SMALL_GROUP = 48
BLOCK = 512
#: The nodes of a group outside its largest component make at most so many blocks, while the sketches of a block fit into BLOCK_BYTES.
COPIES = 16
BLOCK_BYTES = 8 << 20
#: So many other components that a node of a block is paired with at once; of the nodes that had more, those still apart are compared again.
NEAREST = 16
#: So many nodes of each of them, as the nearest by the sketch may be just not similar; each turn so many times more.
NEAREST_EACH = 16
#: Words of 64 bits of the sketch that the rows of a part carry.
ROW_SKETCH = 2
_steps = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; words are split and hashed for all texts at once."""
    lengths, codes, words = split_words(texts)
    hashes = word_hashes(words)[codes]

    def windows(h: np.ndarray, width: int) -> np.ndarray:
        total = np.full(max(0, len(h) - width + 1), width, np.uint64)
        for i in range(width):
            total += h[i : len(h) - width + 1 + i] * _steps[i % len(_steps)] + np.uint64(i // len(_steps))
        return mixed(total)

    whole, out, end = windows(hashes, n) if len(hashes) >= n else hashes[:0], [], 0
    for length in lengths.tolist():
        start, end = end, end + length
        out.append(np.unique(whole[start : end - n + 1] if length >= n else windows(hashes[start:end], length) if length else hashes[:0]))
    return out


@lru_cache(maxsize=4)
def bands(num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """Lower ends of the size bands, and for each band the most that a pair whose smaller set is in it can differ by."""
    ends = [1]
    while ends[-1] < 1 << 40:
        # the larger set of a pair is at most den / num times the smaller: the next band must reach that far
        ends.append(max(ends[-1] + 1, (ends[-1] - 1) * den // num + 1))
    return np.array(ends, np.int64), [(b - 1) * (den - num) // num for b in ends[1:]]


def spare(most: int) -> int:
    """r: how many parts more there are than the pigeonhole needs."""
    return 1 + most // 8


def part_keys(shingles: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the sketch's parts, of the own band and of the band below, and their bands. Empty parts have a key of their own, too."""
    ends, most = bands(num, den)
    band = int(np.searchsorted(ends, len(shingles), "right")) - 1
    keys, of = [], []
    for k in (band, band - 1):
        if k < 0 or most[k] == 0:  # no difference allowed: equal sets are one node already
            continue
        parts = np.uint64(most[k] + 1 + spare(most[k]))
        place = ((shingles >> np.uint64(32)) * parts) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        words = mixed(shingles & np.uint64(0xFFFFFFFF))
        sketch = np.zeros(int(parts), np.uint64)
        sketch[place[starts].astype(np.int64)] = np.bitwise_xor.reduceat(words, starts)
        salt = mixed(np.arange(int(parts), dtype=np.uint64) + np.uint64(k << 32))
        keys.append(mixed(sketch + salt))
        of.append(np.full(int(parts), k, np.int32))
    return (np.concatenate(keys), np.concatenate(of)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int32))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _node(shingles: np.ndarray) -> int | None:
    return _signed(xxhash.xxh3_64_intdigest(shingles.tobytes())) if len(shingles) else None


def nodes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and node (hash of the set, null if empty) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            found = shingle_sets(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, found), pa.int64()), pa.array(map(_node, found), pa.int64())], ["doc_id", "n_shingles", "node"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, node long")


def parts(docs: DataFrame, n: int, num: int, den: int, only: np.ndarray | None = None) -> DataFrame:
    """key, node, band: the parts of each set. Of equal sets that a task meets, only the first is written.

    only: bits of the keys' slots; parts whose slot is not set are left out, and the others come with n, s0, s1: the set's size and sketch."""
    sent = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in slices(batches, "text", SLICE_BYTES):
            keys, of, owners, sizes, sketches = [], [], [], [], []
            for shingles in shingle_sets(batch.column("text"), n):
                node = _node(shingles)
                if node is None or node in met:
                    continue
                if len(met) < 500_000:
                    met.add(node)
                own, band = part_keys(shingles, num, den)
                keys.append(own)
                of.append(band)
                owners.append(np.full(len(own), node, np.int64))
                if sent is not None:
                    sizes.append(np.full(len(own), len(shingles), np.int64))
                    sketches.append(np.tile(bit_sketch(shingles, ROW_SKETCH).view(np.int64), (len(own), 1)))
            if keys:
                made = [np.concatenate(x) for x in (keys, owners, of)]
                if sent is not None:
                    slot = made[0] >> np.uint64(64 - SLOT_BITS)
                    there = (sent.value[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
                    made = [x[there] for x in (*made, np.concatenate(sizes), *np.concatenate(sketches).T)]
                yield pa.RecordBatch.from_arrays([pa.array(made[0].view(np.int64)), *map(pa.array, made[1:])], ["key", "node", "band", *SET_FACTS][: len(made)])

    return docs.select("text").mapInArrow(run, "key long, node long, band int" + ("" if sent is None else "".join(f", {c} long" for c in SET_FACTS)))


#: What a row knows of its set: its size and the words of its sketch.
SET_FACTS = ("n", *(f"s{i}" for i in range(ROW_SKETCH)))


def may_link(a: Callable[[str], Column], b: Callable[[str], Column], num: int, den: int) -> Column:
    """Whether two sets can be similar by their sizes and sketches; a(name) and b(name) give their facts."""
    far = sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in SET_FACTS[1:]), F.lit(0))
    sized = F.least(a("n"), b("n")) * den >= F.greatest(a("n"), b("n")) * num
    return sized & (far * (den + num) <= (a("n") + b("n")) * (den - num))


def slots(keys: DataFrame) -> np.ndarray:
    """A bit for each slot that a key falls in: 2^SLOT_BITS bits whatever the number of keys, as words of 64."""
    slot = F.shiftrightunsigned("key", 64 - SLOT_BITS)
    words = keys.select(F.shiftrightunsigned(slot, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - SLOT_BITS}) & 63 as int))").alias("bit"))
    table, out = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow(), np.zeros(1 << (SLOT_BITS - 6), np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """node and its sorted n-gram hashes, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [x for x in shingle_sets(batch.column("text"), n) if len(x)]
            offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            values = pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, found), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["node", "shingles"])

    return docs.select("text").mapInArrow(run, T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))]))


def few(ids: DataFrame) -> bool:
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def hinted(ids: DataFrame) -> DataFrame:
    """A saved table for a join: broadcast if it was counted to be small, else joined by a shuffle, whose skewed keys Spark splits."""
    return F.broadcast(ids) if few(ids) else ids


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component: the smallest node reachable over edges (a, b), for each node with an edge.

    Each turn sends a node to the least of its neighbours and itself, then to where that is sent, and edges to where their ends are. Edges
    that end in one node are gone, so that later turns read few; the smallest node of a component always stays."""
    tidy = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    now = scratch.save(edges.where("a <> b").select(*tidy("a", "b")).distinct(), f"{name}-edges0")
    sent = []
    for turn in range(1000):
        ends = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("next"))
        jump = least.select(F.col("node").alias("next"), F.col("next").alias("component"))
        sent.append(scratch.save(least.join(jump, "next").select("node", "component"), f"{name}-{turn}"))
        to = lambda c: sent[-1].select(F.col("node").alias(c), F.col("component").alias(f"__{c}"))
        moved = now.join(to("a"), "a").join(to("b"), "b").where("__a <> __b").select(*tidy("__a", "__b")).distinct()
        now = scratch.save(moved, f"{name}-edges{turn + 1}")
        scratch.drop(f"{name}-edges{turn}")
        if not now.head(1):
            break
    else:
        raise RuntimeError("components did not converge")
    labels = sent[0]
    for step in sent[1:]:
        labels = sent_on(labels, step)
    return scratch.save(labels, name)


def sent_on(labels: DataFrame, step: DataFrame) -> DataFrame:
    """labels (node, component) whose components are replaced by those that step (node, component) has for them."""
    then = step.select(F.col("node").alias("component"), F.col("component").alias("then"))
    return labels.join(then, "component", "left").select("node", F.coalesce("then", "component").alias("component"))


def merged(labels: DataFrame | None, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """labels (None: each node is alone) after more edges, of which only those between components are followed."""
    if labels is None:
        return components(edges, scratch, name)
    for c in ("a", "b"):
        edges = edges.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"__{c}")), c, "left")
    found = components(edges.select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b")), scratch, f"{name}-met")
    return scratch.save(sent_on(labels, found).union(found.join(labels, "node", "left_anti").select("node", "component")), name)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("__s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("__t"))
    small, large = F.least(F.size("__s"), F.size("__t")), F.greatest(F.size("__s"), F.size("__t"))
    joined = pairs.join(left, "a").join(right, "b").where(small * den >= large * num)
    shared = F.size(F.array_intersect("__s", "__t")).cast("long")
    return joined.where(shared * den >= (F.size("__s") + F.size("__t") - shared) * num).select("a", "b")


def sketch_words(band: int, num: int, den: int) -> int:
    """64-bit words of a sketch for a band: eight bits for each n-gram that a pair may differ by."""
    return max(8, (bands(num, den)[1][band] + 1) // 8 + 1)


def bit_sketch(shingles: np.ndarray, n_words: int) -> np.ndarray:
    """The parity sketch of a set in n_words words."""
    place = (mixed(shingles) % np.uint64(64 * n_words)).astype(np.int64)
    odd = np.bincount(place, minlength=64 * n_words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def sketched(rows: DataFrame, num: int, den: int) -> DataFrame:
    """node, band, n and sketch: the sizes and the sketches for their bands of sets (node, band, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles"):
            lists = batch.column("shingles")
            sizes, values = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy().view(np.uint64)
            ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)].tolist()
            made = [bit_sketch(values[i:j], sketch_words(k, num, den)).tobytes() for i, j, k in zip(ends, ends[1:], batch.column("band").to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("band"), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["node", "band", "n", "sketch"])

    return rows.select("node", "band", "shingles").mapInArrow(run, "node long, band int, n long, sketch binary")


def nearest(rows: np.ndarray, far: np.ndarray, components: np.ndarray, most: int, each: int) -> np.ndarray:
    """Which pairs to keep: of each row's, the nearest few (each) of a component, in the nearest components, at most so many (most)."""
    order = np.lexsort((far, components, rows))
    starts = np.flatnonzero(np.r_[True, (np.diff(rows[order]) != 0) | (np.diff(components[order]) != 0)][: len(rows)])
    rank = lambda starts, n: np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    by = np.lexsort((far[order[starts]], rows[order[starts]]))
    place = np.empty(len(starts), np.int64)
    place[by] = rank(np.flatnonzero(np.r_[True, np.diff(rows[order[starts]][by]) != 0][: len(by)]), len(by))
    kept = np.zeros(len(rows), bool)
    kept[order] = (rank(starts, len(rows)) < each) & (np.repeat(place, np.diff(np.r_[starts, len(rows)])) < most)
    return kept


def sided(group: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """group (key, node, band, component) with main: whether the node is in the key's largest component; mains, rests: how many nodes are, and are not."""
    counted = group.groupBy("key", "component").agg(F.count(F.lit(1)).alias("often"))
    sums = counted.groupBy("key").agg(F.max(F.struct("often", "component")).alias("top"), F.sum("often").alias("size"))
    sides = scratch.save(sums.select("key", F.col("top.component").alias("first"), F.col("top.often").alias("mains"), (F.col("size") - F.col("top.often")).alias("rests")), name)
    return group.join(hinted(sides), "key").select("key", "node", "band", "component", (F.col("component") == F.col("first")).alias("main"), "mains", "rests")


def compared_in_blocks(group: DataFrame, sketches: DataFrame, num: int, den: int, most: int | None, each: int) -> DataFrame:
    """Pairs (a, b) across components in large groups (sided) whose sketches allow the similarity.

    The largest component and the rest are cut into blocks. A task holds a block of the rest against another of either kind; blocks grow with
    the rest, so that no group is copied more than some 2 * COPIES times while BLOCK_BYTES hold such a block. A task compares BLOCK by BLOCK nodes at
    once; a node of its first block gives its nearest few (each) in at most so many components of the second (None: all). Both nodes of a pair that was not given
    come as rows without b. Nodes of the largest component are compared with the rest alone."""
    rows = group.join(sketches, ["node", "band"])
    held_rows = F.array(*[F.lit(max(1, BLOCK_BYTES // (8 * sketch_words(k, num, den)))) for k in range(len(bands(num, den)[1]))])
    side = F.least(F.element_at(held_rows, F.col("band") + 1), F.greatest(F.lit(BLOCK), F.ceil(F.col("rests") / COPIES)))
    rows = rows.withColumn("r", F.ceil(F.col("rests") / side).cast("int")).withColumn("m", F.ceil(F.col("mains") / side).cast("int"))
    dealt = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    met = rows.withColumn("own", F.when(F.col("main"), F.col("r") + dealt("m")).otherwise(dealt("r")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("r") - 1 + F.when(F.col("main"), 0).otherwise(F.col("m")))))
    met = met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "band", "component", "n", "sketch")
    tile, names = BLOCK, ["key", "band", "a", "b"]

    def held(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, read = key[1].as_py(), key[2].as_py(), []
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            read.append([*(batch.column(c).to_numpy() for c in ("own", "node", "component", "n", "band")), sketch])
        own, node, component, n, band, sketch = map(np.concatenate, zip(*read, strict=True))
        one, two = np.flatnonzero(own == low), np.flatnonzero(own == high)
        left = np.zeros(len(own), bool)

        def rows_of(a: np.ndarray, b: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), key[0].as_py())), pa.array(np.full(len(a), band[0])), pa.array(a), b], names)

        def made(given: np.ndarray) -> pa.RecordBatch:
            a, b = node[given[0]], node[given[1]]
            return rows_of(np.minimum(a, b), pa.array(np.maximum(a, b)))

        for s in range(0, len(one), tile):
            x = one[s : s + tile]
            given = np.empty((3, 0), np.int64)  # places of a and of b, distance
            for t in range(s if low == high else 0, len(two), tile):
                y = two[t : t + tile]
                y_sketch, y_n, y_component = sketch[y], n[y], component[y]
                far, near = np.empty((len(x), len(y)), np.int64), np.empty((len(x), len(y)), bool)
                for i in range(len(x)):
                    far[i] = np.bitwise_count(y_sketch ^ sketch[x[i]]).sum(1, dtype=np.int64)
                    near[i] = (far[i] * (den + num) <= (y_n + n[x[i]]) * (den - num)) & (y_component != component[x[i]])
                i, j = np.nonzero(np.triu(near) if low == high and s == t else near)
                given = np.hstack([given, np.stack([x[i], y[j], far[i, j]])])
                if most is not None:
                    kept = nearest(given[0], given[2], component[given[1]], most, each)
                    left[given[:2, ~kept]] = True
                    given = given[:, kept]
                elif given.shape[1]:
                    yield made(given)
                    given = given[:, :0]
            if given.shape[1]:
                yield made(given)
        yield rows_of(node[left], pa.nulls(int(left.sum()), pa.int64()))

    return met.groupBy("key", "low", "high").applyInArrow(held, "key long, band int, a long, b long")


def still_apart(rows: DataFrame, labels: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """rows (key, node and more) of the keys whose nodes are in different components, with component and the key's size."""
    now = rows.withColumn("component", F.col("node")) if labels is None else rows.join(hinted(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    now = scratch.save(now, f"{name}-now")
    spread = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    apart = scratch.save(spread.where("low <> high").select("key", "size"), f"{name}-sizes")
    found = scratch.save(now.join(hinted(apart), "key"), name)
    scratch.drop(f"{name}-now", f"{name}-sizes")
    return found


def links(docs: DataFrame, rows: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame | None:
    """node, component for the nodes that are linked with others; None if no two nodes share a part."""
    # Groups of a key may be as large as any part of the table: they are summed before they are shuffled, and rows meet the sums in joins.
    spread = lambda c: (F.min(c).alias("low"), F.max(c).alias("high"))
    counted = parts(docs, n, num, den).groupBy("key").agg(*spread("node"), F.count(F.lit(1)).alias("often"))
    counted = scratch.save(counted.where("low <> high").select("key", "often"), "counted")
    if not counted.head(1):
        return None
    # most parts are shared by none: those are left out where they are made
    shared = scratch.save(parts(docs, n, num, den, slots(counted)).join(hinted(counted), "key").distinct(), "shared")
    # the parts that a set shares with most others may be left out; those that it shares with none are last in that order
    by_share = W.partitionBy("node", "band").orderBy(F.desc("often"), "key")
    most = F.array(*[F.lit(spare(m)) for m in bands(num, den)[1]])
    few_left = shared.withColumn("place", F.row_number().over(by_share)).where(F.col("place") > F.element_at(most, F.col("band") + 1)).select("key", "node", "band", *SET_FACTS)
    few_left = scratch.save(few_left, "few")
    scratch.drop("shared", "counted")
    # a key's leaders: the smallest node of each of a few parts of the nodes
    part = F.pmod(F.xxhash64("node"), F.lit(LEADERS))
    leaders = few_left.groupBy("key").agg(*spread("node"), F.array_compact(F.array(*[F.min(F.when(part == i, F.struct("node", *SET_FACTS))) for i in range(LEADERS)])).alias("leaders"))
    leaders = scratch.save(leaders.where("low <> high").select("key", "leaders"), "leaders")
    shared = scratch.save(few_left.join(hinted(leaders), "key"), "remaining")
    scratch.drop("few", "leaders")
    wanted = scratch.save(shared.select("node").distinct(), "wanted")
    if not wanted.head(1):
        return None
    firsts = rows.join(F.broadcast(wanted) if few(wanted) else wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ids = scratch.save(firsts.select(F.coalesce("doc_id", F.lit(-1)).alias("__id")).distinct(), "ids")
    texts = docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__id")).join(F.broadcast(ids) if few(ids) else ids, "__id", "left_semi")
    sets = scratch.save(sets_of(texts, n).join(F.broadcast(wanted) if few(wanted) else wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")

    # first the leaders
    met = shared.select("node", *SET_FACTS, F.explode("leaders").alias("x")).where((F.col("x.node") != F.col("node")) & may_link(F.col, lambda c: F.col(f"x.{c}"), num, den))
    stars = met.select(F.least("x.node", "node").alias("a"), F.greatest("x.node", "node").alias("b")).distinct()
    edges = scratch.save(verified(stars, sets, num, den), "edges1")
    labels = components(edges, scratch, "labels1") if edges.head(1) else None
    # then what is still apart; leaders have met all others of their groups
    now = shared.where(~F.exists("leaders", lambda x: x["node"] == F.col("node"))).select("key", "node", "band", *SET_FACTS)
    group = still_apart(now, labels, scratch, "apart")
    scratch.drop("remaining")
    small = group.where(F.col("size") <= SMALL_GROUP).select("key", "node", "component", *SET_FACTS)
    other = small.select("key", F.col("node").alias("b"), F.col("component").alias("__c"), *[F.col(c).alias(f"__{c}") for c in SET_FACTS])
    apart_still = (F.col("component") != F.col("__c")) & (F.col("node") < F.col("b")) & may_link(F.col, lambda c: F.col(f"__{c}"), num, den)
    pairs = small.join(other, "key").where(apart_still).select(F.col("node").alias("a"), "b")
    large = group.where(F.col("size") > SMALL_GROUP).select("key", "node", "band", "component")
    sketches = scratch.save(sketched(large.select("node", "band").distinct().join(sets, "node"), num, den), "sketches") if large.head(1) else None
    most, turn, cut = NEAREST, 0, True
    while cut:
        cut, turn = False, turn + 1
        if sketches is not None:
            met = scratch.save(compared_in_blocks(sided(large, scratch, f"sides{turn}"), sketches, num, den, most, NEAREST_EACH**turn), f"met{turn}")
            given, left = met.where("b is not null").select("a", "b"), met.where("b is null").select("key", F.col("a").alias("node"), "band").distinct()
            cut = bool(left.head(1))
            pairs = pairs.union(given) if turn == 1 else given
        more = scratch.save(verified(pairs.distinct(), sets, num, den), f"more{turn}")
        found = bool(more.head(1))
        if found:
            labels = merged(labels, more, scratch, f"labels{turn + 1}")
        if cut:
            # where no nearest one is similar, those that were left out still may be; both nodes of such a pair are among those left
            most = most if found else None
            large = still_apart(left, labels, scratch, f"apart{turn}")
            cut = bool(large.head(1))
    scratch.drop("sets", "sketches", "apart", *[f"{x}{i}" for x in ("apart", "sides", "met", "more") for i in range(1, turn + 1)])
    return labels


def grouped(docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, node, component_id and keeper (the node of the row that stands for the component) for each row."""
    rows = scratch.save(nodes(docs, n), "rows")
    labels = links(docs, rows, n, num, den, scratch)
    filled = rows.where(F.col("node").isNotNull())
    # the first row of a node, of a component: the smallest id, a missing one last, then the smallest node
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    groups = filled.groupBy("node").agg(first.alias("first"))
    own = groups.withColumn("component", F.col("node")) if labels is None else groups.join(hinted(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("first").alias("least"))
    named = scratch.save(own.join(least, "component").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.node").alias("keeper")), "named")
    joined = filled.join(hinted(named), "node").select("doc_id", "n_shingles", "node", "component_id", "keeper")
    none = F.lit(None).cast("long")
    return joined.unionByName(rows.where(F.col("node").isNull()).select("doc_id", "n_shingles", "node", F.col("doc_id").alias("component_id"), none.alias("keeper")))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) for each row of docs (doc_id, text).

    num / den: the similarity from which two documents link."""
    return grouped(docs, n, num, den, Scratch(docs.sparkSession, "jaccard")).select("doc_id", "n_shingles", "component_id")


def first_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs of which one stands for each component: that of the smallest id (a missing one last). Rows with an empty set all stay.

    Rows with an id of their own are known by it; those that share an id, or have none, by their id and their set."""
    scratch = Scratch(docs.sparkSession, "firsts")
    found = scratch.save(grouped(docs.select("doc_id", "text"), n, num, den, scratch), "components")
    stays = F.col("node").isNull() | ((F.col("node") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = scratch.save(found.where(~stays & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id")).distinct(), "gone")
    twice = scratch.save(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id"), "twice")
    rows = whole(docs, F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("text"))
    alone = rows.where(F.col("__id").isNotNull()).join(hinted(twice), "__id", "left_anti").join(hinted(gone), "__id", "left_anti").select("whole")
    if not twice.head(1) and not found.where("doc_id is null").head(1):
        return unpacked(alone, docs.columns)
    shared = rows.where(F.col("__id").isNull()).unionByName(rows.where(F.col("__id").isNotNull()).join(hinted(twice), "__id", "left_semi").select(rows.columns))

    def maker():
        return lambda texts: [pa.array(map(_node, shingle_sets(texts, n)), pa.int64())]

    noded = per_row(shared, ["whole", "__id"], "text", [T.StructField("node", T.LongType())], maker)
    keepers = found.where(stays & F.col("node").isNotNull()).select(F.col("doc_id").alias("k_id"), F.col("node").alias("k_node")).distinct()
    kept = noded.join(keepers, (F.col("node") == F.col("k_node")) & F.col("__id").eqNullSafe(F.col("k_id"))).select("whole", "__id", "node")
    once = kept.withColumn("k", F.row_number().over(W.partitionBy("node", "__id").orderBy(F.xxhash64("whole")))).where("k = 1").select("whole")
    return unpacked(alone.unionByName(once).unionByName(noded.where(F.col("node").isNull()).select("whole")), docs.columns)
