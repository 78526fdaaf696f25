"""Phrase collocation mining with weighted acyclic automata.

Every word of a text begins a path: its lang, itself and up to three words that follow in its piece. A task sorts the paths of a shard of text and builds
from them, state by state, an automaton whose last arcs carry counts; states with one and the same arc are one state. Automata are cut at
the boundaries of prefix ranges, drawn from a bounded sample of paths, so that ranges hold about as many paths each and a frequent word or pair of words is
spread over as many as it fills. The automata of a range are united and their weights summed; a phrase's count is the sum below its prefix. Prefixes
that a boundary cuts are summed over their ranges. So all counts of one to four words come from one path for each word, and only paths that differ are shuffled.

Phrases counted often enough are put into one count automaton for each range, and the parts of the candidates, dealt to the ranges in packs, are composed with them:
a part is followed arc by arc, all parts of a pack at once.

Defined cases: a null text is empty, a null lang is 'und'; texts without words count nothing; texts of any length are read whole; repeated rows count again, whatever their ids (null
or not), which are not read; ties go by count and phrase (bytes); an empty table gives an empty result; other columns are ignored, whatever their names."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.texts import _bytes_of, slices
from tessella.plans.scratch import Scratch

MOST_WORDS = 4
#: Parts of a lang whose best phrases are found apart.
LANG_PARTS = 32
DEPTH = MOST_WORDS + 1


@dataclass(frozen=True)
class PhraseParams:
    """least: count of a candidate; inside_percent: a candidate goes if a longer one that holds it is at least so frequent; top: rows of each lang;
    shard_words: words whose paths are sorted at once; range_words: words of a prefix range, about; most_ranges: their boundaries are sent to all tasks (some MB), so
    that beyond most_ranges * range_words words the ranges grow; sample_docs, sample_paths: documents that boundaries are drawn from, and most paths of each; pack: parts
    looked up at once."""

    least: int = 30
    inside_percent: int = 80
    top: int = 2_000
    shard_words: int = 1_000_000
    range_words: int = 500_000
    most_ranges: int = 65_536
    sample_docs: int = 4_000
    sample_paths: int = 256
    pack: int = 4_096
    seed: int = 12


#: Bytes: 0 belongs to a word, 1 parts words, 2 ends a piece.
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \t")] = 1
_KINDS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the texts in lower case (A-Z), whether the next word follows in the same piece, and the number of each text's words."""
    data, offsets = _bytes_of(pc.fill_null(texts, "").cast(pa.large_binary()))
    kinds = _KINDS[data]
    inside = kinds == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    breaks = (kinds == 2).astype(np.int64)
    np.add.at(breaks, heads, 1)
    piece = np.cumsum(breaks)[at]
    together = np.r_[piece[1:] == piece[:-1], False] if len(at) else np.empty(0, bool)
    letters = _LOWER[data[inside]]
    starts = np.cumsum(inside)[at] - 1
    ends = np.r_[starts, len(letters)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters))])
    return words, together, np.diff(np.searchsorted(at, offsets))


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in the order of their bytes, and the place of each word among them."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]


def _sorted(columns: list[np.ndarray], weights: np.ndarray, n_labels: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Distinct paths in order, their summed weights, and for each depth where a new prefix begins."""
    bits = max(1, int(n_labels).bit_length())
    if 3 * bits <= 63:
        keys = (columns[3] << bits | columns[4], columns[0] << 2 * bits | columns[1] << bits | columns[2])
    else:
        keys = tuple(reversed(columns))
    order = np.lexsort(keys)
    columns = [c[order] for c in columns]
    new, differs = [], np.zeros(len(order), bool)
    differs[:1] = True
    for c in columns:
        differs = differs.copy()
        differs[1:] |= c[1:] != c[:-1]
        new.append(differs)
    starts = np.flatnonzero(new[-1])
    summed = np.add.reduceat(weights[order], starts) if len(starts) else np.empty(0, np.int64)
    return [c[starts] for c in columns], summed, [n[starts] for n in new]


class Automaton:
    """An acyclic automaton of depth DEPTH over words; its last arcs carry weights.

    words: labels in the order of their bytes. For each depth, labels of the arcs by source state, first[state] the state's first arc, and
    targets, the states that the arcs lead to; the arcs of the last depth have weights instead."""

    def __init__(self, words: pa.Array, labels: list[np.ndarray], firsts: list[np.ndarray], targets: list[np.ndarray], weights: np.ndarray):
        self.words, self.labels, self.firsts, self.targets, self.weights = words, labels, firsts, targets, weights

    @classmethod
    def of_sorted(cls, words: pa.Array, columns: list[np.ndarray], weights: np.ndarray, new: list[np.ndarray] | None = None) -> Automaton:
        """From distinct sorted paths (a column of places in words for each depth), from the last arcs back to the first state."""
        if new is None:
            _, _, new = _sorted(columns, weights, len(words))
        labels, firsts, targets = [None] * DEPTH, [None] * DEPTH, [None] * DEPTH
        target = weights
        for depth in range(DEPTH - 1, -1, -1):
            arcs = np.flatnonzero(new[depth])
            label = columns[depth][arcs]
            # arcs of one source state stand together; a source is a prefix of this depth
            heads = np.flatnonzero(new[depth - 1][arcs]) if depth else np.zeros(min(1, len(arcs)), np.int64)
            sizes = np.diff(np.r_[heads, len(arcs)])
            alone = sizes == 1
            # states with the same single arc are one; those with more arcs stay
            pairs = np.stack([label[heads[alone]], target[heads[alone]]], 1)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            fresh = np.r_[True, (pairs[order][1:] != pairs[order][:-1]).any(1)] if len(order) else np.empty(0, bool)
            state = np.empty(len(heads), np.int64)
            state[np.flatnonzero(alone)[order]] = np.cumsum(fresh) - 1
            n_alone, many = int(fresh.sum()), np.flatnonzero(~alone)
            state[many] = n_alone + np.arange(len(many))
            kept = pairs[order][fresh]
            rest = np.repeat(~alone, sizes)
            labels[depth] = np.r_[kept[:, 0], label[rest]]
            targets[depth] = np.r_[kept[:, 1], target[rest]]
            firsts[depth] = np.r_[np.arange(n_alone), n_alone + np.r_[0, np.cumsum(sizes[many])]].astype(np.int64)
            target = state
        return cls(words, labels, firsts, targets[:-1], targets[-1])

    def paths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All paths, in order, and their weights."""
        states, columns = np.zeros(min(1, len(self.labels[0])), np.int64), []
        for depth in range(DEPTH):
            first = self.firsts[depth]
            sizes = first[states + 1] - first[states]
            arcs = np.repeat(first[states] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(states) else np.empty(0, np.int64)
            columns = [np.repeat(c, sizes) for c in columns] + [self.labels[depth][arcs]]
            states = self.targets[depth][arcs] if depth < DEPTH - 1 else arcs
        return columns, self.weights[states]

    def weights_of(self, asked: list[pa.Array]) -> np.ndarray:
        """The weights of paths (an array of words for each depth), 0 where there is none: all are followed together, depth by depth."""
        if not len(self.weights):
            return np.zeros(len(asked[0]), np.int64)
        states = np.zeros(len(asked[0]), np.int64)
        alive = np.ones(len(states), bool)
        for depth, words in enumerate(asked):
            label = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
            first = self.firsts[depth]
            keys = np.repeat(np.arange(len(first) - 1), np.diff(first)) * (len(self.words) + 1) + self.labels[depth]
            wanted = states * (len(self.words) + 1) + label
            arc = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            alive &= (label >= 0) & (keys[arc] == wanted)
            arc[~alive] = 0
            states = self.targets[depth][arc] if depth < DEPTH - 1 else arc
            states[~alive] = 0
        return np.where(alive, self.weights[states], 0)

    def packed(self) -> bytes:
        data, offsets = _bytes_of(self.words.cast(pa.large_binary()))
        arrays = [np.diff(offsets), *self.labels, *[np.diff(f) for f in self.firsts], *self.targets, self.weights]
        parts = [np.array([len(a) for a in arrays] + [8 if a.max(initial=0) >= 1 << 32 else 4 for a in arrays], np.int64).tobytes()]
        for a in arrays:
            wide = 8 if a.max(initial=0) >= 1 << 32 else 4
            # bytes of the same rank lie together, so that they pack well
            parts.append(a.astype(np.int64 if wide == 8 else np.uint32).view(np.uint8).reshape(-1, wide).T.tobytes())
        return zstandard.ZstdCompressor(level=1).compress(b"".join([*parts, data.tobytes()]))

    @classmethod
    def unpacked(cls, packed: bytes) -> Automaton:
        raw = zstandard.ZstdDecompressor().decompress(packed)
        n = 1 + 3 * DEPTH
        sizes, at, arrays = np.frombuffer(raw, np.int64, 2 * n), 16 * n, []
        for size, wide in zip(sizes[:n].tolist(), sizes[n:].tolist(), strict=True):
            planes = np.frombuffer(raw, np.uint8, size * wide, at).reshape(wide, size)
            arrays.append(np.ascontiguousarray(planes.T).view(np.int64 if wide == 8 else np.uint32).reshape(-1).astype(np.int64))
            at += size * wide
        whole = lambda a: np.r_[0, np.cumsum(a)].astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(arrays[0]), [None, pa.py_buffer(whole(arrays[0])), pa.py_buffer(raw[at:])])
        return cls(words, arrays[1 : 1 + DEPTH], [whole(a) for a in arrays[1 + DEPTH : 1 + 2 * DEPTH]], arrays[1 + 2 * DEPTH : 3 * DEPTH], arrays[3 * DEPTH])


def united(parts: list[tuple[pa.Array, list[np.ndarray], np.ndarray]]) -> tuple[pa.Array, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Paths of several automata (words, columns, weights) with summed weights: words, columns, weights, new prefixes."""
    words, place = _ranked(pa.concat_arrays([p[0] for p in parts]))
    at, columns = 0, [[] for _ in range(DEPTH)]
    for labels, own, _ in parts:
        mine = place[at : at + len(labels)]
        at += len(labels)
        for c, o in zip(columns, own, strict=True):
            c.append(mine[o])
    columns, weights, new = _sorted([np.concatenate(c) for c in columns], np.concatenate([p[2] for p in parts]), len(words))
    return words, columns, weights, new


class _Shard:
    """Words of whole texts, until their paths are sorted."""

    def __init__(self):
        self.words, self.codes, self.together, self.langs, self.n = [], [], [], [], 0

    def add(self, texts: pa.Array, langs: pa.Array) -> None:
        words, together, each = words_of(texts)
        coded = words.dictionary_encode()
        tongues = pc.fill_null(langs, "und").cast(pa.large_binary()).dictionary_encode()
        self.words += [coded.dictionary, tongues.dictionary]
        self.codes.append(coded.indices.to_numpy().astype(np.int64))
        self.together.append(together)
        self.langs.append(np.repeat(tongues.indices.to_numpy().astype(np.int64), each))
        self.n += len(words)

    def paths(self) -> tuple[pa.Array, list[np.ndarray]]:
        """Labels in order (the empty one first, for no word), and a column of their places for each depth."""
        words, place = _ranked(pa.concat_arrays([pa.array([b""], pa.large_binary()), *self.words]))
        at, code, lang = 1, [], []
        for i, (own, tongues) in enumerate(zip(self.codes, self.langs, strict=True)):
            for codes, out in ((own, code), (tongues, lang)):
                size = len(self.words[2 * i + (out is lang)])
                out.append(place[at : at + size][codes])
                at += size
        columns, near = [np.concatenate(lang), np.concatenate(code)], np.ones(self.n, bool)
        together = np.concatenate(self.together)
        for k in range(1, MOST_WORDS):
            ahead = lambda values, n: np.r_[values[n:], np.zeros(min(n, self.n), values.dtype)]
            near = near & ahead(together, k - 1)
            columns.append(np.where(near, ahead(columns[1], k), 0))
        return words, columns


def _bytes(words: pa.Array, columns: list[np.ndarray], at: int) -> tuple[bytes, ...]:
    return tuple(words[int(c[at])].as_py() for c in columns)


class _At:
    """Paths as a sequence for bisection."""

    def __init__(self, words: pa.Array, columns: list[np.ndarray]):
        self.words, self.columns = words, columns

    def __len__(self) -> int:
        return len(self.columns[0])

    def __getitem__(self, at: int) -> tuple[bytes, ...]:
        return _bytes(self.words, self.columns, at)


def boundaries(docs: DataFrame, text: str, lang: str, params: PhraseParams) -> list[tuple[bytes, ...]]:
    """First paths of all prefix ranges but the first, from a bounded sample of documents."""
    given = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    n_docs = given.count()
    share = min(1.0, params.sample_docs / max(1, n_docs))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                shard = _Shard()
                shard.add(batch.column("text").slice(at, 1), batch.column("lang").slice(at, 1))
                words, columns = shard.paths()
                step = max(64, -(-shard.n // params.sample_paths))
                some = [_bytes(words, columns, i) for i in range((shard.n * 7) % step, shard.n, step)]
                yield pa.RecordBatch.from_arrays([pa.array([some], pa.list_(pa.list_(pa.binary()))), pa.array([shard.n], pa.int64())], ["paths", "n"])

    sampled = (given if share == 1.0 else given.sample(share, params.seed)).mapInArrow(drawn, "paths array<array<binary>>, n long").toArrow()
    n_ranges = min(params.most_ranges, int(sum(sampled.column("n").to_pylist()) / share / params.range_words) + 1)
    paths = sorted(tuple(p) for ps in sampled.column("paths").to_pylist() for p in ps)
    return sorted({paths[len(paths) * i // n_ranges] for i in range(1, n_ranges)}) if paths else []


def shard_automata(docs: DataFrame, text: str, lang: str, cuts: list[tuple[bytes, ...]], params: PhraseParams) -> DataFrame:
    """range, automaton: what every shard counts in each range."""
    given = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()

        def built() -> Iterator[pa.RecordBatch]:
            words, columns = shard.paths()
            columns, weights, new = _sorted(columns, np.ones(shard.n, np.int64), len(words))
            # inner cuts by bisection in the sorted paths
            lazy, at = _At(words, columns), [0]
            for cut in cuts:
                low, high = at[-1], len(lazy)
                while low < high:
                    mid = (low + high) // 2
                    low, high = (mid + 1, high) if lazy[mid] < cut else (low, mid)
                at.append(low)
            at.append(len(lazy))
            for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                if a == b:
                    continue
                used, own = np.unique(np.concatenate([c[a:b] for c in columns]), return_inverse=True)
                fresh = [n[a:b].copy() for n in new]
                for f in fresh:
                    f[0] = True
                made = Automaton.of_sorted(words.take(pa.array(used)), list(own.reshape(DEPTH, b - a)), weights[a:b], fresh)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([made.packed()], pa.binary())], ["range", "automaton"])

        for batch in slices(batches, "text"):
            shard.add(batch.column("text"), batch.column("lang"))
            if shard.n >= params.shard_words:
                yield from built()
                shard = _Shard()
        if shard.n:
            yield from built()

    return given.mapInArrow(run, "range int, automaton binary")


def phrase_counts(docs: DataFrame, cuts: list[tuple[bytes, ...]], text: str = "text", lang: str = "lang", params: PhraseParams = PhraseParams()) -> DataFrame:
    """lang, phrase, words, f: phrases of one to four words that occur least times or more; and for each lang all its words, with an empty phrase and words 0."""
    hold = 4 * params.range_words

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for blob in batch.column("automaton"):
                one = Automaton.unpacked(blob.as_py())
                columns, weights = one.paths()
                held.append((one.words, columns, weights))
                n += len(weights)
                if n > hold and len(held) > 1:  # union as it goes, so that only paths that differ are held
                    words, columns, weights, _ = united(held)
                    held, n = [(words, columns, weights)], min(n // 2, len(weights))
        words, columns, weights, new = united(held)
        for depth in range(DEPTH):
            starts = np.flatnonzero(new[depth])
            f = np.add.reduceat(weights, starts)
            keep = f >= params.least
            keep[[0, -1]] = True  # the range's ends may hold a part of a prefix only
            if depth:
                keep &= columns[depth][starts] > 0 if words[0].as_py() == b"" else True
            else:
                keep[:] = True
            rows = starts[keep]
            tongue = words.take(pa.array(columns[0][rows])).cast(pa.large_string())
            parts = [words.take(pa.array(columns[d][rows])).cast(pa.large_string()) for d in range(1, depth + 1)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if parts else pa.array([""] * len(rows), pa.large_string())
            yield pa.RecordBatch.from_arrays([tongue.cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(rows), depth), pa.int32()), pa.array(f[keep], pa.int64())], ["lang", "phrase", "words", "f"])

    found = shard_automata(docs, text, lang, cuts, params).groupBy("range").applyInArrow(run, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= params.least) | (F.col("words") == 0))


def _path(lang: str, phrase: str) -> tuple[bytes, ...]:
    words = phrase.encode().split(b" ")
    return lang.encode(), *words, *[b""] * (MOST_WORDS - len(words))


def with_parts(counts: DataFrame, cuts: list[tuple[bytes, ...]], params: PhraseParams = PhraseParams()) -> DataFrame:
    """lang, phrase, a, l1..l3, r1..r3: for every candidate the counts of its first k words and of the rest, by composition with the count automata of their ranges."""
    phrases = counts.where("words > 0").select("lang", "phrase", "words", "f")

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [bisect_right(cuts, _path(a, b)) for a, b in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), batch.column("lang"), batch.column("phrase"), batch.column("f")], ["range", "lang", "phrase", "f"])

    def built(table: pa.Table) -> pa.Table:
        paths = sorted(zip((_path(a, b) for a, b in zip(table.column("lang").to_pylist(), table.column("phrase").to_pylist(), strict=True)), table.column("f").to_pylist(), strict=True))
        words, place = _ranked(pa.array([w for path, _ in paths for w in path], pa.large_binary()))
        columns = list(place.reshape(-1, DEPTH).T)
        made = Automaton.of_sorted(words, columns, np.array([f for _, f in paths], np.int64))
        return pa.table({"range": table.column("range").slice(0, 1), "automaton": pa.array([made.packed()], pa.binary())})

    automata = phrases.mapInArrow(ranged, "range int, lang string, phrase string, f long").groupBy("range").applyInArrow(built, "range int, automaton binary")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, list[tuple]] = {}

        def out(where: int) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("side", pa.int32()), ("part", pa.string())]))
            rows = [dict(zip(("lang", "phrase", "a", "side", "part"), r, strict=True)) for r in packs.pop(where)]
            return pa.RecordBatch.from_arrays([pa.array([where], pa.int32()), pa.array([rows], kind)], ["range", "pack"])

        for batch in batches:
            for tongue, phrase, a in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "f")), strict=True):
                words = phrase.split(" ")
                for k in range(1, len(words)):
                    for side, part in ((k, " ".join(words[:k])), (-k, " ".join(words[k:]))):
                        where = bisect_right(cuts, _path(tongue, part))
                        packs.setdefault(where, []).append((tongue, phrase, a, side, part))
                        if len(packs[where]) >= params.pack:
                            yield out(where)
        for where in list(packs):
            yield out(where)

    kind = "range int, pack array<struct<lang:string,phrase:string,a:bigint,side:int,part:string>>"
    packs = phrases.where("words > 1").select("lang", "phrase", "f").mapInArrow(asked, kind)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("pack").slice(i, 1).flatten()
                one = Automaton.unpacked(batch.column("automaton")[i].as_py())
                paths = [_path(a, b) for a, b in zip(rows.field("lang").to_pylist(), rows.field("part").to_pylist(), strict=True)]
                f = one.weights_of([pa.array([p[d] for p in paths], pa.large_binary()) for d in range(DEPTH)])
                yield pa.RecordBatch.from_arrays([*[rows.field(c) for c in ("lang", "phrase", "a", "side")], pa.array(f, pa.int64())], ["lang", "phrase", "a", "side", "f"])

    found = packs.join(automata, "range").select("pack", "automaton").mapInArrow(composed, "lang string, phrase string, a long, side int, f long")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    return found.groupBy("lang", "phrase", "a").agg(*[of(k).alias(f"l{k}") for k in range(1, MOST_WORDS)], *[of(-k).alias(f"r{k}") for k in range(1, MOST_WORDS)])


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored(parts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score: by the lowest-scoring cut, the first of those that score alike."""
    cuts = [
        F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"(2000000bd * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))").cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, MOST_WORDS)
    ]
    return parts.select("lang", "phrase", "a", F.array_min(F.array_compact(F.array(*cuts))).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def inside_longer(counts: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """lang, phrase of candidates that a longer candidate holds and nearly always comes with."""
    words = F.split("phrase", " ")
    part = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    held = F.when(F.col("words") == 3, F.array(part(1, 2), part(2, 2))).otherwise(F.array(part(1, 2), part(2, 2), part(3, 2), part(1, 3), part(2, 3)))
    longest = counts.where("words > 2").select("lang", F.explode(held).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    both = counts.where("words > 1").select("lang", "phrase", "f").join(longest, ["lang", "phrase"])
    return both.where(_exact(F.lit(100)) * _exact(F.col("longer")) >= _exact(F.lit(params.inside_percent)) * _exact(F.col("f"))).select("lang", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", params: PhraseParams = PhraseParams()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each lang."""
    scratch = Scratch(docs.sparkSession, "phrases")
    cuts = boundaries(docs, text, lang, params)
    counts = scratch.save(phrase_counts(docs, cuts, text, lang, params), "counts")
    left = scored(with_parts(counts, cuts, params)).join(inside_longer(counts, params), ["lang", "phrase"], "left_anti")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # the best of each part of a lang first, so that no task gets more of a lang than a fixed number of lists
    parted = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(LANG_PARTS)))
    some = parted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= params.top).drop("part", "rank")
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= params.top)
    sizes = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
