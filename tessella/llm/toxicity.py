"""Toxicity by a counterfactual-regularised classifier.

A document is the set of its lower-case words and of their beginnings; a logistic regression is fitted
on labelled documents, over the features that these show more often in toxic documents than chance
allows. Sentences of the sample that mention an identity term are written again with
every other term of the same kind, and the squared change of the score is penalised, so that the mention of
a group as such does not move a score. Terms that the sample never shows have no weight at all.

The classifier is fitted on the driver from a bounded sample (most_rows) of labelled rows; that bound
holds for the sample only: every document is scored, on its whole text.

Defined cases: a null or empty text has no features and scores the base rate of the sample; labels that
are null take no part; without labelled rows, or with labels of one kind only, the score is the smoothed
base rate; several labels of a document: it counts as toxic if one says so; equal texts get equal scores;
a very long text is scored whole, as the set of its words; an empty table gives an empty result;
a column of the input named like a result is replaced."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.texts import per_row, slices, unpacked, whole
from tessella.plans.scratch import Scratch

#: Identity terms by kind, in the languages of the documents; a term is swapped for every other of its kind.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "hispanic", "african", "arab"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("american", "mexican", "chinese", "indian", "german", "french", "russian"),
    ("disabled", "blind", "deaf", "old", "young"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "katholiken", "atheisten"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("ausländer", "einwanderer", "flüchtlinge", "einheimische"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques", "athées"),
    ("femmes", "hommes", "filles", "garçons"),
    ("immigrés", "réfugiés", "étrangers", "habitants"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos", "ateos"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("inmigrantes", "refugiados", "extranjeros", "vecinos"),
)
PREFIXES = (4, 5, 6)
#: Tasks that the sample's features are made in.
SAMPLE_PARTS = 16
_words = re.compile(r"\w+").findall
_sentences = re.compile(r"[.!?\n]+").split


@dataclass(frozen=True)
class Fit:
    """most_rows: labelled rows in the sample; ridge and fairness: weights of the two penalties; rounds: steps of the descent;
    identity: terms by kind, for which others of their kind are put."""

    most_rows: int = 8_000
    ridge: float = 2e-4
    fairness: float = 1.0
    rounds: int = 600
    identity: tuple[tuple[str, ...], ...] = IDENTITY_TERMS


def _feature(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) >> 1


class _Features(dict):
    """The features of words seen before."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = (_feature(word), *(_feature(f"{word[:n]}*") for n in PREFIXES if len(word) > n or len(word) == n))
        return value


def features(text: str, known: _Features) -> set[int]:
    found: set[int] = set()
    found.update(*map(known.__getitem__, set(_words(text.lower()))))
    return found


def swapped(text: str, kinds: dict[str, tuple[str, ...]]) -> Iterator[tuple[str, str]]:
    """Each sentence with an identity term, and the same sentence under every other term of its kind."""
    for sentence in _sentences(text):
        words = _words(sentence.lower())
        for term in dict.fromkeys(w for w in words if w in kinds):
            for other in kinds[term]:
                if other != term:
                    yield " ".join(words), " ".join(other if w == term else w for w in words)


def sample(rows: DataFrame, fit: Fit, scratch: Scratch) -> DataFrame:
    """row, features, toxic and swaps of at most fit.most_rows rows (text, toxic): the smallest hashes of id and text, so that the
    choice is the same each time. A swap is the features that a sentence has and its rewriting lacks, -1, and the other way round."""
    hashed = rows.where(F.col("toxic").isNotNull()).withColumn("row", F.xxhash64(F.lit(3), "doc_id", "text"))
    chosen = hashed.orderBy("row").limit(fit.most_rows).select("row", "text", F.col("toxic").cast("int").alias("toxic")).repartition(SAMPLE_PARTS, "row")
    kinds = {term: kind for kind in fit.identity for term in kind}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sides = []
            for text in texts:
                pairs = [(features(a, known), features(b, known)) for a, b in swapped(text, kinds)]
                sides.append([[*sorted(a - b), -1, *sorted(b - a)] for a, b in pairs])
            made = [pa.array([sorted(features(t, known)) for t in texts], pa.list_(pa.int64())), batch.column("toxic"), pa.array(sides, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], ["row", "features", "toxic", "swaps"])

    return scratch.save(chosen.mapInArrow(run, "row long, features array<long>, toxic int, swaps array<array<long>>"), "features")


def telling(found: DataFrame, rate: float, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The features that are more frequent in toxic rows than chance allows, and in how many rows they are: the log-likelihood ratio
    must exceed what the best of as many features without meaning would reach."""
    each = found.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("toxic") > 0).cast("long")).alias("toxic"))
    each = scratch.save(each, "counts")
    n, clean = each.count(), F.col("rows") - F.col("toxic")
    expected = F.col("rows") * F.lit(rate)
    ratio = F.when(F.col("toxic") > 0, F.col("toxic") * F.log(F.col("toxic") / expected)).otherwise(0.0) + F.when(clean > 0, clean * F.log(clean / (F.col("rows") - expected))).otherwise(0.0)
    kept = each.where((F.col("toxic") > expected) & (2 * ratio > 2 * float(np.log(max(2, n))) + 2)).select("feature", "rows").toArrow()
    names, rows = kept.column("feature").to_numpy(), kept.column("rows").to_numpy()
    order = np.argsort(names)
    return names[order], rows[order]


def of_names(found: DataFrame, names: np.ndarray) -> pa.Table:
    """The sample with only these features; they are bounded by the sample's size."""
    sent = found.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = set(sent.value.tolist())
        for batch in batches:
            lists = [[x for x in values if x in mine] for values in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lists, pa.list_(pa.int64())), batch.column("toxic"), batch.column("swaps")], ["row", "features", "toxic", "swaps"])

    return found.mapInArrow(run, found.schema).toArrow().sort_by("row")


class Model:
    """Weights by feature and a bias; pairs: how many rewritten sentences the sample gave."""

    def __init__(self, weights: dict[int, float], bias: float, pairs: int = 0):
        self.weights, self.bias, self.pairs = weights, bias, pairs

    def logit(self, found: set[int]) -> float:
        get = self.weights.get
        # summed in a fixed order: equal texts get equal scores
        return self.bias + float(sum(sorted(filter(None, map(get, found)))))

    def score(self, text: str, known: _Features) -> float:
        z = self.logit(features(text, known))
        return float(1 / (1 + np.exp(-min(60.0, max(-60.0, z)))))


def descended(table: pa.Table, names: np.ndarray, occurs: np.ndarray, fit: Fit) -> Model:
    """Logistic regression by gradient descent with momentum on the sample's sparse features. Equal swaps are one, with a weight."""
    lists = table.column("features").combine_chunks()
    y = table.column("toxic").to_numpy() > 0
    n, m = len(y), len(names)
    rows, columns = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets))), np.searchsorted(names, np.asarray(lists.flatten()))
    place = {int(x): i for i, x in enumerate(names)}
    swaps = Counter(tuple(x for x in s if x == -1 or x in place) for swaps in table.column("swaps").to_pylist() for s in swaps or [])
    total = sum(swaps.values())
    swaps.pop((-1,), None)  # nothing that the model knows changes
    pr, pc, ps, weight = [], [], [], np.array(list(swaps.values()), float) / max(1, total)
    for i, sides in enumerate(swaps):
        middle = sides.index(-1)
        for k, x in enumerate(sides):
            if k != middle:
                pr.append(i)
                pc.append(place[x])
                ps.append(1.0 if k < middle else -1.0)
    pr, pc, ps = np.array(pr, int), np.array(pc, int), np.array(ps, float)
    # rare features move slower: a step is scaled by how often a feature occurs
    w, velocity, bias, bias_velocity = np.zeros(m), np.zeros(m), 0.0, 0.0
    swayed = fit.fairness * np.bincount(pc, weight[pr], m) / 4 if len(pr) else 0.0
    scale = 1 / (np.sqrt(occurs / n) + 0.02 + 4 * swayed)
    for _ in range(fit.rounds):
        z = np.bincount(rows, w[columns], n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * np.where(y, 2.0, 1.0) / n
        gradient = np.bincount(columns, error[rows], m) + fit.ridge * w * (0.05 + 1 / np.sqrt(occurs))
        if len(pr):
            change = np.bincount(pr, ps * w[pc], len(weight)) / 4
            gradient += fit.fairness * np.bincount(pc, ps * (weight * change)[pr], m)
        velocity = 0.9 * velocity - 0.3 * scale * gradient
        bias_velocity = 0.9 * bias_velocity - 0.3 * error.sum()
        w, bias = w + velocity, bias + bias_velocity
    used = np.abs(w) > 1e-4
    return Model({int(k): float(v) for k, v in zip(names[used], w[used], strict=True)}, float(bias), total)


def trained(rows: DataFrame, fit: Fit = Fit()) -> Model:
    """A model from labelled rows (doc_id, text, toxic)."""
    scratch = Scratch(rows.sparkSession, "toxicity")
    found = sample(rows, fit, scratch)
    n, n_toxic = found.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).head()
    if not n_toxic or n_toxic == n:
        return Model({}, float(np.log((n_toxic + 1) / (n - n_toxic + 1)) if n else -2.2))
    names, occurs = telling(found, n_toxic / n, scratch)
    model = descended(of_names(found, names), names, occurs, fit)
    scratch.drop("features", "counts")
    return model


def scored(docs: DataFrame, model: Model, columns: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Columns of docs (default: all), score and predicted. The model has at most the sample's features and is sent as a broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps((model.weights, model.bias)))

    def maker():
        own, known = Model(*pickle.loads(sent.value)), _Features()

        def make(texts: pa.Array) -> list[pa.Array]:
            scores = [own.score(t or "", known) for t in texts.to_pylist()]
            return [pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())]

        return make

    results = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return per_row(docs, docs.columns if columns is None else columns, "text", results, maker)


def labelled(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """doc_id, text and toxic of at most fit.most_rows labelled documents that may be learnt from (crc32 of the id mod 4 is not 2).

    The sample is drawn from the labels, which carry no text; its ids, bounded by the parameter, are broadcast, so that no text is shuffled."""
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = one.orderBy(F.xxhash64(F.lit(3), "__id"), "__id").limit(fit.most_rows)
    mine = docs.select("doc_id", "text")
    return mine.join(F.broadcast(drawn), mine["doc_id"] == F.col("__id")).select("doc_id", "text", "toxic")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns."""
    return unpacked(scored(whole(docs, "text"), model, ["whole"], threshold).where("predicted = 0"), docs.columns)
