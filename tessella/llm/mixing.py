"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions only.

Each source gets a target in words: its share of the total by weight, at most most_repeats times its own
size, what is over being shared out again by weight. A source's documents are dealt to blocks by hash;
the mix takes whole epochs of its blocks, then documents by blocks in permuted order up to the target, as
near to it as whole documents come: documents longer than half of the words still missing wait, and what
a cut leaves is filled in further rounds from the blocks and documents after it. Of a source of which
more than half is still to be taken, what is left out is chosen in this way. The block quotas of
all sources are then split over the output shards: a tree halves the shards, and at each node a
multivariate-hypergeometric draw says how many of each source's blocks go left, so that every shard gets
its exact number of blocks and no block is drawn twice. Shards shuffle locally, by mix_key.

Only counts go through the tree. Tables that are small by nature (a row for each source, block, or
source and shard) are the only ones that are sorted as a whole; documents are never sorted or grouped
by source, so that a hot source costs no more than others.

Defined cases: a null source is a source (last in order), a null text or one without words has size 0 and
is taken with its block; equal rows are taken alike; an empty table gives an empty mix; columns of the
input are kept, and those named like a result are replaced. Results depend on the rows alone, not on
their order or partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.texts import WORD
from tessella.plans.scratch import Scratch

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A table of at most so many blocks (some MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_BLOCKS = 100_000
RESULTS = ("size", "source_size", "target", "taken", "draws")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: float = 3.0) -> DataFrame:
    """Adds rank, weight and target (double) to sources (source, source_size).

    Sharing out again until none is above its cap has a closed form: in order of cap / weight, the first
    sources are at their caps and the others share the rest by weight; the split is where the rest's
    level first falls below the next source's cap / weight."""
    alone = W.partitionBy(F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(alone.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = ranked.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most_repeats)), "whole": F.sum("source_size").over(alone)})
    by_cap = alone.orderBy(F.col("cap") / F.col("weight"), "rank")
    rows = rows.withColumns({
        "capped": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "sharing": F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)),
    })
    level = F.greatest(F.lit(0.0), (F.col("whole") - F.col("capped")) / F.col("sharing"))
    rows = rows.withColumn("first", F.min(F.when(F.col("cap") / F.col("weight") > level, F.struct(F.col("cap") / F.col("weight"), F.col("rank"), level.alias("level")))).over(alone))
    target = F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("first.level")), F.col("cap"))
    return rows.select("source", "source_size", "rank", "weight", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of drawn things are marked, by inversion of the exact distribution at u. All are longs.

    Weights follow from k to k + 1 by their ratio, in logarithms; one pass sums them, a second finds u. Only counts
    within 12 standard deviations and 40 of the mean are gone through: by Bernstein's bound those beyond it have less
    than 2^-53 of the weight, which is less than any u."""
    n = F.greatest(F.lit(1).cast("long"), population).cast("double")
    mean = drawn.cast("double") * marked.cast("double") / n
    variance = mean * (n - marked) / n * (n - drawn) / F.greatest(F.lit(1.0), n - 1)
    spread = F.sqrt(F.greatest(F.lit(0.0), variance)) * 12 + 40
    low = F.greatest(F.lit(0).cast("long"), drawn - (population - marked), F.floor(mean - spread).cast("long"))
    high = F.least(marked, drawn, F.ceil(mean + spread).cast("long"))

    def ratio(k: Column) -> Column:
        up = F.greatest(F.lit(1).cast("long"), marked - k).cast("double") * F.greatest(F.lit(1).cast("long"), drawn - k).cast("double")
        down = (k + 1).cast("double") * F.greatest(F.lit(1).cast("long"), population - marked - drawn + k + 1).cast("double")
        return F.log(up) - F.log(down)

    def add(a: Column, k: Column) -> Column:
        top = F.greatest(a["top"], a["w"])
        total = a["total"] * F.exp(a["top"] - top) + F.exp(a["w"] - top)
        return F.struct((a["w"] + ratio(k)).alias("w"), top.alias("top"), total.alias("total"))

    zero = F.lit(0.0)
    ks = F.sequence(low, high)
    sums = F.aggregate(ks, F.struct(zero.alias("w"), zero.alias("top"), zero.alias("total")), add)

    def find(a: Column, k: Column) -> Column:
        seen = a["seen"] + F.exp(a["w"] - a["top"]) / a["total"]
        return F.struct((a["w"] + ratio(k)).alias("w"), a["top"].alias("top"), a["total"].alias("total"), seen.alias("seen"), F.when((a["at"] < 0) & (seen >= u), k).otherwise(a["at"]).alias("at"))

    begin = F.struct(zero.alias("w"), sums["top"].alias("top"), sums["total"].alias("total"), zero.alias("seen"), F.lit(-1).cast("long").alias("at"))
    found = F.aggregate(ks, begin, find, lambda a: F.when(a["at"] < 0, high).otherwise(a["at"]))
    return F.when(low == high, low).otherwise(found)


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """rank, shard, lo, hi: shard's part [lo, hi) of the source's blocks, from quotas (rank, quota).

    One row for each node of the tree's present level; its quotas are an array over sources."""
    node = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("q")).select(F.lit(0).alias("first"), F.lit(shards).alias("n"), "q")
    total = lambda q: F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)
    width = shards
    while width > 1:
        left_n = F.floor(F.col("n") / 2).cast("int")
        node = node.withColumn("all", total(F.col("q"))).withColumn("take", F.floor(F.col("all") * left_n / F.greatest(F.col("n"), F.lit(1))).cast("long"))
        each = F.transform("q", lambda x, i: F.struct(x.alias("x"), i.alias("i")))

        def draw(a: Column, e: Column) -> Column:
            k = hypergeometric(a["left"], e["x"], a["take"], _uniform(F.lit(seed), F.col("first"), F.col("n"), e["i"]))
            return F.struct((a["left"] - e["x"]).alias("left"), (a["take"] - k).alias("take"), F.concat(a["out"], F.array(k)).alias("out"))

        begin = F.struct(F.col("all").alias("left"), F.col("take").alias("take"), F.array().cast("array<bigint>").alias("out"))
        drawn = node.withColumn("left", F.aggregate(each, begin, draw, lambda a: a["out"]))
        left = F.struct(F.col("first").alias("first"), left_n.alias("n"), F.col("left").alias("q"))
        right = F.struct((F.col("first") + left_n).alias("first"), (F.col("n") - left_n).cast("int").alias("n"), F.zip_with("q", "left", lambda a, b: a - b).alias("q"))
        whole = F.struct(F.col("first").alias("first"), F.col("n").alias("n"), F.col("q").alias("q"))
        node = drawn.select(F.explode(F.when(F.col("n") > 1, F.array(left, right)).otherwise(F.array(whole))).alias("x")).select("x.*")
        width = (width + 1) // 2
    parts = node.select(F.col("first").alias("shard"), F.posexplode("q").alias("place", "blocks"))
    up = W.partitionBy("place").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    hi = F.sum("blocks").over(up)
    return parts.select("place", "shard", (hi - F.col("blocks")).alias("lo"), hi.alias("hi"))


def topped_up(placed: DataFrame, rests: DataFrame, few: bool, scratch: Scratch) -> DataFrame:
    """rank, rounds, one, reach: what of each source fills its rest in words, from placed (rank, place, size, __h) and rests (rank, rest).

    A round takes, in order of place and __h, the documents of at most limit words (half of the room) after the last
    round's cut, up to the room. It either leaves less than half of the room or takes all of them; then
    at most one document more comes nearer to the rest (one is its __h). rounds holds limit, begin and end
    (both left out); reach is the last place that a round or one comes to, null for all."""
    at = lambda place, h: F.struct(place.alias("place"), h.alias("h"))
    here = at(F.col("place").cast("long"), F.col("__h"))
    small = F.broadcast if few else lambda x: x
    begin = at(F.lit(-1).cast("long"), F.lit(0).cast("long"))
    none = F.array().cast("array<struct<limit:double,begin:struct<place:bigint,h:bigint>,end:struct<place:bigint,h:bigint>>>")
    state = rests.select("rank", F.col("rest").cast("double").alias("room"), begin.alias("begin"), none.alias("rounds"), (F.col("rest") >= 2).alias("open"))
    turn = 0
    while True:
        state = scratch.save(state, f"fill{turn}")
        if turn:
            scratch.drop(f"fill{turn - 1}")
        if state.where("open").isEmpty():
            break
        turn += 1
        fits = placed.join(small(state.where("open").select("rank", "room", "begin")), "rank").where((F.col("size") > 0) & (F.col("size") <= F.col("room") / 2) & (here > F.col("begin")))
        upto = F.sum("words").over(W.partitionBy("rank").orderBy("place"))
        sums = fits.groupBy("rank", "place").agg(F.sum("size").alias("words"), F.max("room").alias("room")).withColumn("upto", upto)
        over = F.col("upto") > F.col("room")
        ends = sums.groupBy("rank").agg(F.max("upto").alias("total"), F.min(F.when(over, F.struct("place", (F.col("upto") - F.col("words")).alias("before")))).alias("cut"))
        ends = scratch.save(ends, f"ends{turn}")
        cuts = ends.where("cut is not null").select("rank", F.col("cut.place").alias("place"), F.col("cut.before").alias("before"))
        inside = fits.join(small(cuts), ["rank", "place"]).groupBy("rank", "place", "room", "before", "__h").agg(F.sum("size").alias("words"))
        inside = inside.withColumn("upto", F.col("before") + F.sum("words").over(W.partitionBy("rank").orderBy("__h")))
        last = inside.groupBy("rank").agg(F.max(F.when(~over, F.col("upto"))).alias("got"), F.min(F.when(over, here)).alias("end"), F.max("before").alias("before"))
        joined = state.join(ends.select("rank", "total"), "rank", "left").join(last, "rank", "left")
        taken = F.when(F.col("end").isNull(), F.coalesce("total", F.lit(0))).otherwise(F.coalesce("got", "before"))
        step = F.struct((F.col("room") / 2).alias("limit"), F.col("begin").alias("begin"), F.col("end").alias("end"))
        now = F.col("open")
        left = F.when(now, F.col("room") - taken).otherwise(F.col("room"))
        state = joined.select(
            "rank", left.alias("room"), F.when(now & F.col("end").isNotNull(), F.col("end")).otherwise(F.col("begin")).alias("begin"),
            F.when(now, F.concat("rounds", F.array(step))).otherwise(F.col("rounds")).alias("rounds"), (now & F.col("end").isNotNull() & (left >= 2)).alias("open"),
        )
    more = placed.join(small(state.where("room > 0").select("rank", "room", "rounds")), "rank").where((F.col("size") > 0) & (F.col("size") < 2 * F.col("room")) & ~in_rounds())
    one = more.groupBy("rank", "room", "place", "__h").agg(F.sum("size").alias("size")).where(F.col("size") < 2 * F.col("room"))
    one = one.groupBy("rank").agg(F.min(F.struct(F.abs(F.col("size") - F.col("room")), here.alias("at"))).alias("x")).select("rank", F.col("x.at").alias("one"))
    ended = F.transform("rounds", lambda r: r["end"]["place"])
    reach = F.when(F.exists(ended, lambda x: x.isNull()), F.lit(None)).otherwise(F.greatest(F.lit(-1).cast("long"), F.array_max(ended), F.col("one.place")))
    return scratch.save(state.join(one, "rank", "left").select("rank", "rounds", F.col("one.h").alias("one"), reach.alias("reach")), "filled")


def in_rounds() -> Column:
    """Whether a document (place, __h, size) is in one of the rounds."""
    here = F.struct(F.col("place").cast("long").alias("place"), F.col("__h").alias("h"))
    return F.exists("rounds", lambda r: (F.col("size") > 0) & (F.col("size") <= r["limit"]) & (here > r["begin"]) & (r["end"].isNull() | (here < r["end"])))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: float = 3.0, shards: int = 16, block_words: int = 20_000, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """docs with RESULTS: size in words, its source's size and target, the words taken of it, and draws: an array of
    (epoch, shard, mix_key), one for each time that the mix takes the document.

    A block of a source holds some block_words words, or the root of the source's words where that is more: the number
    of blocks and what a block holds both grow with the root of a large source, so that neither the tree's draws nor a
    cut within a block become one task's large work."""
    scratch = Scratch(docs.sparkSession, "mix")
    names = [c for c in docs.columns if c not in RESULTS]
    # the input's columns travel in one struct, so that none clashes with those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), "source", word_count().alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.col("text")).alias("__h"))
    slim = scratch.save(rows.select("source", "size", "__h"), "slim")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(float(block_words)), F.sqrt("source_size")))).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(0).cast("long")
    sources = targets(sizes, weights, most_repeats).withColumns({"n_blocks": n_blocks, "epochs": epochs})
    sources = scratch.save(sources.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))), "sources")
    few = sources.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    of_source = F.broadcast(sources) if few else sources

    block = F.pmod(F.col("__h"), F.col("n_blocks"))
    placed = slim.join(of_source.select(F.col("source").alias("__s"), "rank", "n_blocks"), slim["source"].eqNullSafe(F.col("__s"))).select("rank", block.alias("block"), "size", "__h")
    shuffled = placed.groupBy("rank", "block").agg(F.sum("size").alias("words")).withColumn("place", F.row_number().over(W.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), "rank", "block"), "block")) - 1)
    shuffled = scratch.save(shuffled, "places")
    few_blocks = shuffled.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    at = shuffled.select("rank", "block", "place")
    lined = scratch.save(placed.join(F.broadcast(at) if few_blocks else at, ["rank", "block"]).select("rank", "place", "size", "__h"), "lined")
    most = F.col("rest") * 2 > F.col("source_size")
    filled = topped_up(lined, sources.select("rank", F.when(most, F.greatest(F.lit(0.0), F.col("source_size") - F.col("rest"))).otherwise(F.col("rest")).alias("rest")), few, scratch)
    filled = filled.join(sources.select("rank", most.alias("most")), "rank")
    rests = sources.select("rank", "epochs", "rest").join(filled, "rank")
    # a block is taken once more if documents of it may fill the rest
    blocks = shuffled.join(F.broadcast(rests) if few else rests, "rank")
    blocks = scratch.save(blocks.withColumn("again", (F.col("rest") > 0) & (F.col("most") | F.col("reach").isNull() | (F.col("place") <= F.col("reach")))).drop("rounds", "one"), "blocks")

    taken_blocks = blocks.groupBy("rank").agg((F.max("epochs") * F.count(F.lit(1)) + F.sum(F.col("again").cast("long"))).alias("quota"))
    places = taken_blocks.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("rank")) - 1)
    tree = splitting_tree(taken_blocks, shards, seed).join(places.select("place", "rank"), "place")
    ends = scratch.save(tree.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "hi"))), lambda x: x["hi"]).alias("ends")), "ends")

    count = F.count(F.lit(1)).over(W.partitionBy("rank"))
    marked = blocks.withColumn("count", count).join(ends, "rank")
    again = F.col("again").cast("int")
    times = F.when(F.col("epochs") + again > 0, F.sequence(F.lit(0).cast("long"), F.col("epochs") + again - 1)).otherwise(F.array().cast("array<bigint>"))
    # unit number of this block in each epoch, and the shard whose part holds it
    draws = F.transform(times, lambda e: F.struct(e.alias("epoch"), F.size(F.filter("ends", lambda h: h <= e * F.col("count") + F.col("place"))).alias("shard")))
    lookup = scratch.save(marked.select("rank", "block", "place", "epochs", draws.alias("block_draws")), "draws")
    small = lookup.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS

    named = rows.join(of_source.select(F.col("source").alias("__s"), "rank", "n_blocks", "source_size", "target"), rows["source"].eqNullSafe(F.col("__s"))).withColumn("block", block)
    out = named.join(F.broadcast(lookup) if small else lookup, ["rank", "block"]).join(F.broadcast(filled) if few else filled, "rank")
    # a document without words goes with its block
    chosen = in_rounds() | F.coalesce(F.col("__h") == F.col("one"), F.lit(False))
    fills = (F.col("size") == 0) | (chosen != F.col("most"))
    own = F.filter("block_draws", lambda d: (d["epoch"] < F.col("epochs")) | fills)
    keyed = F.transform(own, lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed), F.col("__h"), d["epoch"]).alias("mix_key")))
    out = out.withColumn("draws", keyed)
    return out.select("__row.*", "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"), "draws")


def emitted(mix: DataFrame) -> DataFrame:
    """One row for each draw, with its shard and mix_key; sorting a shard by mix_key shuffles it locally."""
    return mix.select(*[F.col(f"`{c}`") for c in mix.columns if c not in RESULTS], F.explode("draws").alias("__d")).select("*", "__d.*").drop("__d")


def mixed_rows(docs: DataFrame, pieces: int = 64) -> DataFrame:
    """Rows of docs, with all their columns, as often as the mix takes them: a shard's rows lie in pieces, drawn at random and shuffled each."""
    mix = mixed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", "source", "text"))
    drawn = mix.select("whole", F.explode("draws").alias("d")).select("whole", "d.shard", "d.mix_key")
    return drawn.repartition("shard", F.pmod("mix_key", F.lit(pieces))).sortWithinPartitions("shard", "mix_key").select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])


def write_mix(mix: DataFrame, path: str) -> None:
    """Writes one folder for each shard, shuffled."""
    rows = emitted(mix)
    rows.repartition("shard").sortWithinPartitions("shard", "mix_key").write.partitionBy("shard").parquet(path)
