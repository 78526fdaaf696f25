"""Brown class-based n-grams.

Words are assigned to classes by exchange clustering: each word moves to the class that makes the class
bigrams of the training text likeliest. Every known word takes part: words seen least_count times or more, whatever the size of the text,
in rounds (the head_words most frequent in turn; then all of them, a round being a job over the words' neighbours against the class bigrams of the round before, half of the words at a time), rarer words
once, by the same criterion from their own neighbours. The number of classes grows with the root of the number
of words in rounds. Unknown words belong to classes of their form (their ending). A text's probability is
the product, over its words and its end, of the class's probability after the class before and of the
word's in its class:

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

Class transitions are smoothed with the classes' own frequencies (Witten-Bell). A form class holds the
unknown word alone; its transitions are those of words seen once, each counted as an unknown word of its form
too (Good-Turing). Together with the unknown words, all probabilities after a class sum to 1.

Counts of words and class bigrams cover the whole training text and are summed by Spark. The driver and the
tasks hold the hash, count and class of each word in rounds (17 to 24 bytes), and the class bigrams; rarer words stay in
a table and are joined with the words of each document, however many there are.

Defined cases: lower case is of A-Z only; a null or empty text is the end token alone; a document without
an id is learnt from; equal rows get equal scores; a very long text is scored whole; columns of the input other than
doc_id and text are ignored, whatever their names; without training documents N and V are 0 and every
token is unknown; an empty table gives an empty result. Words are known by 64-bit hashes."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.texts import endings, signed_hashes, slices, split_words
from tessella.plans.scratch import Scratch


#: Bytes of text that a task takes on at once: words met in them are hashed once. More would save little time and cost memory.
SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class ClassParams:
    """exchange_classes: the least number of classes; least_count: words seen so often are clustered in rounds; most_words: a caller may have so many of them
    at most, by a share of the text that each has to hold (17 to 24 bytes of each are broadcast), there is no such limit unless it is given; head_words: so many of them first, in turn. exchange_words is the number of words in rounds and follows from the corpus."""

    exchange_words: int = 0
    exchange_classes: int = 64
    form_classes: int = 64
    iterations: int = 4
    least_count: int = 5
    head_words: int = 2_048
    most_words: int = 1 << 62

    def least(self, n_words: int) -> int:
        """Words seen so often are in rounds: least_count, unless a caller limits them to most_words; of n_words words in all, at most n_words / least can be."""
        return max(self.least_count, -(-n_words // self.most_words))

    @property
    def end(self) -> int:
        """The id of the end of a text, after exchange words and forms."""
        return self.exchange_words + self.form_classes

    @property
    def end_class(self) -> int:
        return self.exchange_classes + self.form_classes


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))


def _summed(hashes: list[np.ndarray], forms: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """h, form, n with each hash once."""
    h, form, n = np.concatenate(hashes), np.concatenate(forms), np.concatenate(counts)
    order = np.argsort(h)
    h, form, n = h[order], form[order], n[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return pa.RecordBatch.from_arrays([pa.array(h[starts]), pa.array(form[starts]), pa.array(np.add.reduceat(n, starts))], ["h", "form", "n"])


def word_counts(docs: DataFrame, params: ClassParams) -> DataFrame:
    """h, form, n of each word; counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, forms, counts, many = [], [], [], 0
        for batch in slices(batches, "text", SLICE_BYTES):
            _, codes, words = split_words(batch.column("text"))
            n = np.bincount(codes, minlength=len(words))
            met = n > 0
            hashes.append(signed_hashes(words)[met])
            forms.append(_forms(words, params)[met])
            counts.append(n[met])
            many += int(met.sum())
            if many > 1_000_000:
                yield _summed(hashes, forms, counts)
                hashes, forms, counts, many = [], [], [], 0
        if many:
            yield _summed(hashes, forms, counts)

    found = docs.select("text").mapInArrow(run, "h long, form int, n long")
    return found.groupBy("h").agg(F.max("form").alias("form"), F.sum("n").alias("n"))


def _forms(words: pa.Array, params: ClassParams) -> np.ndarray:
    return (endings(words) % np.uint64(params.form_classes)).astype(np.int32)


def _numbered(words: pa.Array, hashes: np.ndarray, params: ClassParams) -> tuple[np.ndarray, np.ndarray]:
    """The id of each distinct word (its place in the sorted hashes of words in rounds, or its form's id) and its hash."""
    h = signed_hashes(words)
    at = hashes.searchsorted(h)
    known = np.zeros(len(h), bool)
    inside = at < len(hashes)
    known[inside] = hashes[at[inside]] == h[inside]
    return np.where(known, at, params.exchange_words + _forms(words, params)), h


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchanged(left: np.ndarray, right: np.ndarray, classes: np.ndarray, matrix: np.ndarray, n_classes: int) -> np.ndarray:
    """One pass of exchange over the words, most frequent first. left, right: each word's neighbours by class; matrix: bigrams of classes."""
    classes, n = classes.copy(), matrix.astype(float)
    rows, columns = n.sum(1), n.sum(0)
    own = np.arange(n_classes)
    for w in range(len(classes)):
        before, after, was = left[w], right[w], classes[w]
        if not before.sum() and not after.sum():
            continue
        n[was] -= after
        n[:, was] -= before
        rows[was] -= after.sum()
        columns[was] -= before.sum()
        at_after, at_before = np.flatnonzero(after), np.flatnonzero(before)
        block, turned = n[:n_classes][:, at_after], n[at_before][:, :n_classes]
        gain = (_xlogx(block + after[at_after]) - _xlogx(block)).sum(1) + (_xlogx(turned + before[at_before][:, None]) - _xlogx(turned)).sum(0)
        gain -= _xlogx(rows[own] + after.sum()) - _xlogx(rows[own]) + _xlogx(columns[own] + before.sum()) - _xlogx(columns[own])
        now = int(gain.argmax()) if gain.max() > gain[was] + 1e-9 else was
        n[now] += after
        n[:, now] += before
        rows[now] += after.sum()
        columns[now] += before.sum()
        classes[w] = now
    return classes


def class_of_ids(classes: np.ndarray, params: ClassParams) -> np.ndarray:
    return np.r_[classes, params.exchange_classes + np.arange(params.form_classes + 1)]


@dataclass
class ClassModel:
    """What scoring needs beside the rare words. kept_*: hashes (sorted) and counts of the words in rounds, classes their classes."""

    params: ClassParams
    train_tokens: int
    n_types: int
    kept_hashes: np.ndarray | None
    kept_counts: np.ndarray | None
    classes: np.ndarray | None
    log_transitions: np.ndarray
    class_tokens: np.ndarray
    end_count: int = 0

    def log_base(self, count: np.ndarray | float) -> np.ndarray | float:
        return np.log10((count + 1) / (self.train_tokens + self.n_types + 1))


def _lists(key: np.ndarray, width: int, n: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Rows of id, neighbours (int32) and counts (int64, as bytes) from sorted keys id * width + neighbour."""
    ids = key // width
    starts = np.r_[np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]), len(ids)] if len(ids) else np.zeros(1, np.int64)
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(starts.searchsorted(starts[at] + most, "right")) - 1)
        lo, hi = starts[at], starts[to]
        offsets = starts[at : to + 1] - lo
        packed = [pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((offsets * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x in ((key[lo:hi] % width).astype(np.int32), n[lo:hi])]
        yield pa.array(ids[starts[at:to]].astype(np.int32)), *packed
        at = to


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, and where each row begins."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // size


PAIRS = "id int, nbr binary, n binary, a int, b int, ah long, bh long"


def _in_line(lengths: np.ndarray, values: np.ndarray, between) -> np.ndarray:
    """The values of all texts in a row, with one more before, between and after the texts."""
    out = np.full(len(values) + len(lengths) + 1, between, values.dtype)
    out[np.arange(len(values)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)] = values
    return out


def pairs(docs: DataFrame, sent, params: ClassParams) -> DataFrame:
    """Of each task: id, nbr, n for the neighbours of words in rounds (those before at nbr + width), and rows a, b, ah, bh for each pair with a rare word (its form's id and hash) or of two ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, end, width = params.exchange_words, params.end, params.end + 1
        keys, many = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            keys.clear()
            for i, nbr, count in _lists(found, 2 * width, n.astype(np.int32)):
                none = [pa.nulls(len(i), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([i, nbr, count, *none], ["id", "nbr", "n", "a", "b", "ah", "bh"])

        for batch in slices(batches, "text", SLICE_BYTES):
            lengths, codes, words = split_words(batch.column("text"))
            ids, h = _numbered(words, sent.value, params)
            own, hashes = _in_line(lengths, ids[codes], end), _in_line(lengths, h[codes], 0)
            a, b = own[:-1], own[1:]
            far_a, far_b = a >= m, b >= m
            keys += [(a * (2 * width) + b)[~far_a], (b * (2 * width) + width + a)[~far_b]]
            many += len(keys[-1]) + len(keys[-2])
            if many > 4_000_000:
                yield from out()
                many = 0
            at = np.flatnonzero((far_a & (a < end)) | (far_b & (b < end)) | (far_a & far_b))
            a, b, ah, bh = a[at], b[at], hashes[:-1][at], hashes[1:][at]
            plain = lambda x: (x < m) | (x == end)
            none = [pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary())]
            made = [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(ah, mask=plain(a)), pa.array(bh, mask=plain(b))]
            yield pa.RecordBatch.from_arrays([*none, *made], ["id", "nbr", "n", "a", "b", "ah", "bh"])
        if keys:
            yield from out()

    return docs.select("text").mapInArrow(run, PAIRS)


def neighbours(found: DataFrame, params: ClassParams) -> DataFrame:
    """id, nbr, n: one row for each word in rounds."""
    width = 2 * (params.end + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            nbr, offsets = _unpacked(batch.column("nbr"), np.int32)
            keys.append(np.repeat(batch.column("id").to_numpy().astype(np.int64), np.diff(offsets)) * width + nbr)
            counts.append(_unpacked(batch.column("n"), np.int32)[0].astype(np.int64))
        if keys:
            key, n = np.concatenate(keys), np.concatenate(counts)
            keys.clear()
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            for arrays in _lists(key[starts], width, np.add.reduceat(n, starts) if len(key) else n):
                yield pa.RecordBatch.from_arrays(list(arrays), ["id", "nbr", "n"])

    return found.where("id is not null").select("id", "nbr", "n").repartition("id").mapInArrow(run, "id int, nbr binary, n binary")


class _Choice:
    """The exchange criterion against fixed class bigrams. A word is given by its counts of classes after it, then before it."""

    exact_from = 9

    def __init__(self, matrix: np.ndarray, n_classes: int):
        c = self.c = n_classes
        self.table = np.concatenate([matrix[:c].T, matrix[:, :c]]).astype(float)
        self.steps = np.stack([self.gain(self.table, k) for k in range(self.exact_from)])
        self.sums = np.stack([matrix.sum(1)[:c], matrix.sum(0)[:c]]).astype(float)

    @staticmethod
    def gain(x: np.ndarray, more: np.ndarray | int) -> np.ndarray:
        x = np.maximum(x, 0)
        return _xlogx(x + more) - _xlogx(x)

    def __call__(self, counts: np.ndarray, was: np.ndarray) -> np.ndarray:
        """The best class of each word (rows of counts), which is in class was now; classes from n_classes on are none of the exchange."""
        rows, width = len(counts), counts.shape[1] // 2
        sums = np.stack([counts[:, :width].sum(1), counts[:, width:].sum(1)])
        score = -self.gain(self.sums[0][None, :], sums[0][:, None]) - self.gain(self.sums[1][None, :], sums[1][:, None])
        word, cell = np.nonzero(counts)
        n = counts[word, cell]
        for at in range(0, len(word), 20_000):
            part = slice(at, at + 20_000)
            w, d, k = word[part], cell[part], n[part]
            made = self.steps[np.minimum(k, self.exact_from - 1).astype(np.int64), d]
            big = k >= self.exact_from
            made[big] = self.gain(self.table[d[big]], k[big][:, None])
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            score[w[starts]] += np.add.reduceat(made, starts, axis=0)
        inside = was < self.c
        home = np.where(inside, was, 0)
        x = self.table[cell, home[word]]
        stay = np.bincount(word, self.gain(x - n, n), rows)
        for s, total in zip(self.sums, sums, strict=True):
            stay -= self.gain(s[home] - total, total)
        at = np.arange(rows)
        score[at[inside], home[inside]] = stay[inside]
        best = score.argmax(1)
        return np.where(inside & (score[at, best] <= stay + 1e-9), was, best)


def _counts(batch: pa.RecordBatch, whole: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids, and counts of classes after and before, of the words of a batch of neighbours."""
    ids = batch.column("id").to_numpy()
    (near, offsets), (n, _) = _unpacked(batch.column("nbr"), np.int32), _unpacked(batch.column("n"), np.int64)
    for at in range(0, len(ids), 2_000):
        ends = offsets[at : at + 2_001]
        part, rows = slice(ends[0], ends[-1]), len(ends) - 1
        cls = whole[near[part] % len(whole)] + width * (near[part] >= len(whole))
        key = np.repeat(np.arange(rows), np.diff(ends)) * (2 * width) + cls
        yield ids[at : at + 2_000], np.bincount(key, n[part], 2 * width * rows).reshape(rows, 2 * width)


def _class_bigrams(near: DataFrame, classes: np.ndarray, params: ClassParams) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of classes with a word in rounds: all, and those with no rare word."""
    width, m = params.end_class + 1, params.exchange_words
    sent = near.sparkSession.sparkContext.broadcast(class_of_ids(classes, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, total = sent.value, np.zeros((2, width * width))
        for batch in batches:
            (other, offsets), (n, _) = _unpacked(batch.column("nbr"), np.int32), _unpacked(batch.column("n"), np.int64)
            own = np.repeat(batch.column("id").to_numpy(), np.diff(offsets))
            before = other >= len(whole)
            other = other % len(whole)
            far = other >= m
            use = ~before | far  # a pair of two words in rounds counts once
            key = np.where(before, whole[other] * width + whole[own], whole[own] * width + whole[other])
            rare = far & (other < m + params.form_classes)
            for side, mask in enumerate((use & ~rare, use & rare)):
                total[side] += np.bincount(key[mask], n[mask], width * width)
        for side in (0, 1):
            used = np.flatnonzero(total[side])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), side, np.int32)), pa.array(used.astype(np.int64)), pa.array(total[side][used].astype(np.int64))], ["side", "cell", "n"])

    found = near.mapInArrow(run, "side int, cell long, n long").groupBy("side", "cell").agg(F.sum("n").alias("n")).toArrow()
    side, cell, n = (found.column(c).to_numpy() for c in ("side", "cell", "n"))
    made = np.zeros((2, width * width))
    made[side, cell] = n
    made = made.reshape(2, width, width)
    return made.sum(0), made[0]


def _moved(near: DataFrame, classes: np.ndarray, matrix: np.ndarray, params: ClassParams, turn: int) -> np.ndarray:
    """Classes after a round: words without a class choose one, of the others every second."""
    sent = near.sparkSession.sparkContext.broadcast((class_of_ids(classes, params), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, table = sent.value
        choice = _Choice(table, params.exchange_classes)
        for batch in batches:
            for ids, counts in _counts(batch, whole, len(table)):
                was = whole[ids]
                turns = np.flatnonzero((was >= params.exchange_classes) | ((ids + turn) % 2 == 0))
                now = choice(counts[turns], was[turns])
                moved = now != was[turns]
                yield pa.RecordBatch.from_arrays([pa.array(ids[turns][moved].astype(np.int32)), pa.array(now[moved].astype(np.int32))], ["id", "class"])

    found = near.mapInArrow(run, "id int, class int").toArrow()
    out = classes.copy()
    out[found.column("id").to_numpy()] = found.column("class").to_numpy()
    return out


def _likelihood(matrix: np.ndarray) -> float:
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(0)).sum() - _xlogx(matrix.sum(1)).sum())


def _head_counts(near: DataFrame, code: np.ndarray, head: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours of the frequent words, of which only those of other frequent words are told apart: numbers
    (place of the word * 2 + (1: before)) * kinds + code, and counts. At most 2 * head_words * kinds of them, whatever the corpus."""
    sent = near.sparkSession.sparkContext.broadcast((code, {int(i): k for k, i in enumerate(head)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, place = sent.value
        for batch in batches:
            (nbr, offsets), (n, _) = _unpacked(batch.column("nbr"), np.int32), _unpacked(batch.column("n"), np.int64)
            own = np.array([place.get(i, -1) for i in batch.column("id").to_pylist()])
            for k in np.flatnonzero(own >= 0):
                part = slice(offsets[k], offsets[k + 1])
                key = kinds * (nbr[part] >= len(codes)) + codes[nbr[part] % len(codes)]
                total = np.bincount(key, n[part], 2 * kinds)
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array((2 * kinds * own[k] + used).astype(np.int32)), pa.array(total[used].astype(np.int64))], ["key", "n"])

    found = near.where(F.col("id").isin([int(i) for i in head])).mapInArrow(run, "key int, n long").toArrow()
    return found.column("key").to_numpy(), found.column("n").to_numpy()


def _exchange_head(near: DataFrame, head: np.ndarray, classes: np.ndarray, base: np.ndarray, params: ClassParams) -> np.ndarray:
    """The most frequent words in turn, the others being in classes of their form.

    Class bigrams of pairs without a frequent word stay as they are; those of the others follow from the frequent words' own neighbours."""
    if not len(head):
        return classes
    width, size, first_form = params.end_class + 1, len(head), params.exchange_classes
    kinds = size + params.form_classes + 1
    code = size + class_of_ids(classes, params) - first_form
    code[head] = np.arange(size)
    key, n = _head_counts(near, code.astype(np.int32), head, kinds)
    own, before, other = key // (2 * kinds), key // kinds % 2, key % kinds
    once = (before == 0) | (other >= size)  # a pair of two frequent words is in the lists of both

    def of_codes(classes: np.ndarray) -> np.ndarray:
        return np.r_[classes[head], first_form + np.arange(params.form_classes + 1)]

    def with_head(cls: np.ndarray) -> np.ndarray:
        x, y = cls[own[once]], cls[other[once]]
        cell = np.where(before[once] == 1, y * width + x, x * width + y)
        return np.bincount(cell, n[once], width * width).reshape(width, width)

    fixed = _class_bigrams(near, classes, params)[0] + base - with_head(of_codes(classes))
    for _ in range(params.iterations):
        cls = of_codes(classes)
        table = np.bincount(own * (2 * width) + width * before + cls[other], n, 2 * width * size).reshape(size, 2 * width)
        now = exchanged(table[:, width:], table[:, :width], classes[head], fixed + with_head(cls), params.exchange_classes)
        moved = int((now != classes[head]).sum())
        classes = classes.copy()
        classes[head] = now
        if moved * 1000 < size:
            break
    return classes


def _place_rare(open_: DataFrame, matrix: np.ndarray, params: ClassParams) -> DataFrame:
    """h, class, n of each rare word: the best class by its own neighbours. With these rows, of each task and without h: x, y, n, the class
    bigrams of pairs of which one word is rare; a word seen once counts in its class, and as an unknown word of its form."""
    width = params.end_class + 1
    sent = open_.sparkSession.sparkContext.broadcast(matrix)
    names = ["h", "class", "n", "x", "y"]

    def chosen(choice: _Choice, row: np.ndarray, cell: np.ndarray, n: np.ndarray, many: int) -> np.ndarray:
        """The class of each of many words, from its cells (row: the word's number, in order)."""
        best, starts = np.empty(many, np.int64), np.searchsorted(row, np.arange(many + 1))
        for at in range(0, many, 2_000):
            part, rows = slice(starts[at], starts[min(many, at + 2_000)]), min(2_000, many - at)
            counts = np.bincount((row[part] - at) * (2 * width) + cell[part], n[part], 2 * width * rows).reshape(rows, 2 * width)
            best[at : at + rows] = choice(counts, np.full(rows, params.exchange_classes))
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "cell", "own", "both")] for b in batches if b.num_rows]
        if not read:
            return
        h, cell, own, both = (np.concatenate(x) for x in zip(*read, strict=True))
        read.clear()
        order = np.argsort(h, kind="stable")
        h, cell, own, both = h[order], cell[order].astype(np.int64), own[order], both[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[first, len(h)])
        word, one = np.repeat(np.arange(len(first)), size), np.ones(len(h), np.int64)
        choice, cls = _Choice(sent.value, params.exchange_classes), np.empty(len(first), np.int64)
        # words seen once have one class before and one after: each such pair of classes is judged once
        once = size == 2
        at = first[once]
        kinds, kind = np.unique(np.minimum(cell[at], cell[at + 1]) * (2 * width) + np.maximum(cell[at], cell[at + 1]), return_inverse=True)
        cells = np.stack([kinds // (2 * width), kinds % (2 * width)], 1).ravel()
        cls[once] = chosen(choice, np.repeat(np.arange(len(kinds)), 2), cells, np.ones(len(cells), np.int64), len(kinds))[kind]
        more = ~once[word]
        cls[~once] = chosen(choice, (np.cumsum(~once) - 1)[word[more]], cell[more], one[more], int((~once).sum()))
        none = lambda t, k: pa.nulls(k, t)
        for k in range(0, len(first), 200_000):
            part = slice(k, k + 200_000)
            found = [pa.array(h[first[part]]), pa.array(cls[part].astype(np.int32)), pa.array(size[part] // 2)]
            yield pa.RecordBatch.from_arrays([*found, *[none(pa.int32(), len(found[0]))] * 2], names)
        alone = ~both
        is_after, other = cell < width, cell % width
        total = np.zeros(width * width)
        for mine, rows in ((cls[word], alone), (own.astype(np.int64), alone & once[word])):
            key = np.where(is_after, mine * width + other, other * width + mine)[rows]
            total += np.bincount(key, minlength=width * width)
        used = np.flatnonzero(total)
        cells = [pa.array(total[used].astype(np.int64)), pa.array((used // width).astype(np.int32)), pa.array((used % width).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([none(pa.int64(), len(used)), none(pa.int32(), len(used)), *cells], names)

    both = F.col("ah").isNotNull() & F.col("bh").isNotNull()
    after = open_.where("ah is not null").select(F.col("ah").alias("h"), F.col("bc").alias("cell"), F.col("ac").alias("own"), both.alias("both"))
    before = open_.where("bh is not null").select(F.col("bh").alias("h"), (F.col("ac") + width).alias("cell"), F.col("bc").alias("own"), both.alias("both"))
    return after.unionByName(before).repartition("h").mapInArrow(run, "h long, class int, n long, x int, y int")


def trained(docs: DataFrame, scratch: Scratch, params: ClassParams) -> tuple[ClassModel, DataFrame]:
    """The model of docs (text) with a class for every known word, and the rare words: h, class, n."""
    lexicon = scratch.save(word_counts(docs, params), "lexicon")
    n_docs = docs.count()
    sums = lexicon.agg(F.sum("n"), F.count(F.lit(1))).head()
    tokens, types = (sums[0] or 0) + n_docs, sums[1] + (n_docs > 0)
    kept = lexicon.where(F.col("n") >= params.least(sums[0] or 0)).toArrow()  # the words in rounds: a hash, a count and a form each
    hashes, counts, forms = (kept.column(c).to_numpy() for c in ("h", "n", "form"))
    order = np.argsort(hashes)
    hashes, counts, forms = hashes[order], counts[order], forms[order]
    scratch.drop("lexicon")
    m = len(hashes)
    params = replace(params, exchange_words=m, exchange_classes=max(params.exchange_classes, math.isqrt(m) // 4))
    width, first_form = params.end_class + 1, params.exchange_classes
    spark = docs.sparkSession
    found = scratch.save(pairs(docs, spark.sparkContext.broadcast(hashes), params), "pairs")
    near = scratch.save(neighbours(found, params), "near")

    def cells(rows: DataFrame) -> np.ndarray:
        made, table = rows.groupBy("x", "y").agg(F.sum("n").alias("n")).toArrow(), np.zeros((width, width))
        table[made.column("x").to_numpy(), made.column("y").to_numpy()] = made.column("n").to_numpy()
        return table

    shift = m - first_form
    base = cells(found.where(f"a >= {m} and b >= {m}").select((F.col("a") - shift).alias("x"), (F.col("b") - shift).alias("y"), F.lit(1).alias("n")))
    head = np.lexsort((hashes, -counts))[: params.head_words]
    classes = (first_form + forms).astype(np.int64)
    classes[head] = np.arange(len(head)) % params.exchange_classes
    classes = _exchange_head(near, head, classes, base, params)
    best = None
    for turn in range(params.iterations + 1):
        matrix, plain = _class_bigrams(near, classes, params)
        matrix += base
        now = _likelihood(matrix)
        # the first round leaves the form classes; from then on, a round counts only if it raises the likelihood
        if turn > 1 and now <= best[0]:
            break
        best = (now, classes, matrix, plain)
        if turn < params.iterations:
            after = _moved(near, classes, matrix, params, turn)
            if turn and int((after != classes).sum()) * 1000 < m:
                break
            classes = after
    _, classes, matrix, plain = best
    if params.iterations == 0:
        classes = np.where(classes < first_form, classes, 0)
    sent = spark.sparkContext.broadcast(class_of_ids(classes, params))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array(sent.value[batch.column(c).to_numpy()].astype(np.int32)) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*made, batch.column("ah"), batch.column("bh")], ["ac", "bc", "ah", "bh"])

    open_ = scratch.save(found.where("id is null").select("a", "b", "ah", "bh").mapInArrow(named, "ac int, bc int, ah long, bh long"), "open")
    scratch.drop("pairs", "near")
    placed = scratch.save(_place_rare(open_, matrix, params), "rare")
    rare = placed.where("h is not null").select("h", "class", "n")
    # pairs of two rare words meet both their classes
    left = rare.select(F.col("h").alias("ah"), F.col("class").alias("a_class"), (F.col("n") == 1).alias("a_once"))
    right = rare.select(F.col("h").alias("bh"), F.col("class").alias("b_class"), (F.col("n") == 1).alias("b_once"))
    met = open_.where("ah is not null and bh is not null").join(left, "ah").join(right, "bh")
    pair = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    each = F.array(pair("a_class", "b_class"), F.when(F.col("a_once"), pair("ac", "b_class")), F.when(F.col("b_once"), pair("a_class", "bc")))
    known = met.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("x.*", F.lit(1).cast("long").alias("n"))
    ends = open_.where("ah is null and bh is null").select(F.col("ac").alias("x"), F.col("bc").alias("y"), F.lit(1).cast("long").alias("n"))
    matrix = plain + cells(placed.where("h is null").select("x", "y", "n").unionByName(known).unionByName(ends))
    scratch.drop("open")

    class_tokens = np.zeros(width)
    np.add.at(class_tokens, classes, counts)
    for c, n in rare.groupBy("class").agg(F.sum("n")).collect():
        class_tokens[c] += n
    alive = np.r_[class_tokens[:first_form] > 0, np.ones(params.form_classes + 1, bool)]  # an empty class has no probability
    class_tokens[first_form : params.end_class] = 1
    own = matrix.sum(0)
    prior = (own + alive) / (own.sum() + alive.sum())
    followers = np.maximum((matrix > 0).sum(1), 1)[:, None]
    transitions = (matrix + followers * prior) / (matrix.sum(1, keepdims=True) + followers)
    model = ClassModel(params, int(tokens), int(types), hashes, counts, classes, np.log10(np.maximum(transitions, 1e-300)), class_tokens, n_docs)
    return model, rare


WHOLE = ["doc_id", "held_out", "n_tokens", "n_known", "base_part", "model_part", "rare_h", "rare_form", "rare_n", "open_a", "open_b"]


def partly_scored(docs: DataFrame, model: ClassModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base and model parts that need no rare words; the rare words of each text (hash, form, count);
    open_a, open_b: the classes of pairs with a rare word, for which -1 - its place in rare_h stands."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        params, end = own.params, own.params.end_class
        m, whole = params.exchange_words, class_of_ids(own.classes, params).astype(np.int64)
        none = np.zeros(params.form_classes + 1)
        emission = np.r_[np.log10(np.maximum(own.kept_counts, 1)) - np.log10(np.maximum(own.class_tokens[own.classes], 1)), none]
        base = np.r_[own.log_base(own.kept_counts), none]
        end_known, end_base, steps = int(own.end_count > 0), own.log_base(own.end_count), own.log_transitions
        for batch in slices(batches, "text", SLICE_BYTES):
            lengths, codes, words = split_words(batch.column("text"))
            ids, h = _numbered(words, own.kept_hashes, params)
            rows, token = len(lengths), ids[codes]
            row = np.repeat(np.arange(rows), lengths)
            rare = token >= m
            # rare words of each text, each once
            key, back, times = np.unique(row[rare] * len(words) + codes[rare], return_inverse=True, return_counts=True)
            of_row, code = key // max(1, len(words)), key % max(1, len(words))
            starts = np.searchsorted(of_row, np.arange(rows + 1)).astype(np.int32)
            cls = whole[token]
            cls[rare] = -1 - (back - starts[row[rare]])
            line, line_row = _in_line(lengths, cls, end), np.repeat(np.arange(rows), lengths + 1)
            a, b = line[:-1], line[1:]
            closed = (a >= 0) & (b >= 0)
            score = np.bincount(line_row[closed], steps[a[closed], b[closed]], rows) + np.bincount(row, emission[token], rows)
            open_ = np.flatnonzero(~closed)
            open_at = np.searchsorted(line_row[open_], np.arange(rows + 1)).astype(np.int32)
            plain = [
                pa.array(lengths + 1), pa.array(lengths - np.bincount(row[rare], minlength=rows) + end_known), pa.array(np.bincount(row, base[token], rows) + end_base), pa.array(score),
            ]
            lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(x)) for x in (h[code], (ids[code] - m).astype(np.int32), times.astype(np.int32))]
            lists += [pa.ListArray.from_arrays(pa.array(open_at), pa.array(x[open_].astype(np.int32))) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *plain, *lists], WHOLE)

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_part double, model_part double, rare_h array<long>, rare_form array<int>, rare_n array<int>, open_a array<int>, open_b array<int>")


def scored(docs: DataFrame, params: ClassParams = ClassParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity for each row of docs (doc_id, text), with a model of those not held out."""
    scratch = Scratch(docs.sparkSession, "lm")
    model, rare = trained(docs.where(~held_out()), scratch, params)
    parts = scratch.save(partly_scored(docs, model).withColumn("row", F.monotonically_increasing_id()), "parts")
    met = parts.select("row", F.posexplode("rare_h").alias("pos", "h")).join(rare, "h")
    found = met.groupBy("row").agg(F.collect_list(F.struct("pos", "class", "n")).alias("found")).select("row", *[F.col(f"found.{c}").alias(f"found_{c}") for c in ("pos", "class", "n")])
    joined = parts.drop("rare_h").join(found, "row", "left")
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(replace(model, kept_hashes=None, kept_counts=None, classes=None)))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)

        def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
            """The row of each value, and the values; a null list is empty."""
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)

        for batch in batches:
            many = len(batch)
            row, form = flat(batch.column("rare_form"))
            begin = np.searchsorted(row, np.arange(many))
            cls, n = own.params.exchange_classes + form.astype(np.int64), np.zeros(len(form), np.int64)
            at_row, pos = flat(batch.column("found_pos"))
            at = begin[at_row] + pos.astype(np.int64)
            cls[at], n[at] = flat(batch.column("found_class"))[1], flat(batch.column("found_n"))[1]
            times = flat(batch.column("rare_n"))[1]
            emission = np.log10(np.maximum(n, 1)) - np.log10(np.maximum(own.class_tokens[cls], 1))
            base = np.bincount(row, times * own.log_base(n), many)
            score = np.bincount(row, times * emission, many)
            in_row, a = flat(batch.column("open_a"))
            ends = []
            for code in (a.astype(np.int64), flat(batch.column("open_b"))[1].astype(np.int64)):
                open_ = code < 0
                code = code.copy()
                code[open_] = cls[begin[in_row[open_]] - 1 - code[open_]]
                ends.append(code)
            score += np.bincount(in_row, own.log_transitions[ends[0], ends[1]], many)
            known = np.bincount(row, times * (n > 0), many).astype(np.int64)
            sums = [pa.array(batch.column("n_known").to_numpy() + known), pa.array(batch.column("base_part").to_numpy() + base), pa.array(batch.column("model_part").to_numpy() + score)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), *sums], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = joined.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
