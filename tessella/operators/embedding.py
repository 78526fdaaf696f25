"""Embeddings: a hashing embedder, an interface for models, and a cache of embeddings."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tessella.plans.scratch import delete, exists, read_text, write_text


class Embedder(Protocol):
    """A model: its name, its dimension, and vectors of length 1 for a batch of texts. It is loaded once per worker."""

    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Words hashed to signed places of a vector, by how often they occur; no model is needed.

    The first eight hexadecimal digits of a word's MD5 give the place, the ninth the sign."""

    def __init__(self, dim: int = 384):
        self.dim, self.name = dim, f"hashing-{dim}"
        self._places: dict[str, tuple[int, float]] = {}

    def _place(self, word: str) -> tuple[int, float]:
        if (found := self._places.get(word)) is None:
            if len(self._places) > 200_000:
                self._places.clear()
            digest = hashlib.md5(word.encode()).hexdigest()
            found = self._places[word] = int(digest[:8], 16) % self.dim, 1.0 if int(digest[8], 16) < 8 else -1.0
        return found

    def embed(self, texts: list[str]) -> np.ndarray:
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pa.array([t.lower() for t in texts], pa.string()), r"[^\p{L}\p{N}_]+", " "))
        words = lists.flatten().dictionary_encode()
        # each distinct word is hashed once; an empty one stands beside leading and trailing spaces
        found = np.array([(self._place(w) if w else (0, 0.0)) for w in words.dictionary.to_pylist()]).reshape(-1, 2)
        place, sign = found[:, 0].astype(np.int64), found[:, 1]
        code, row = words.indices.to_numpy(), np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        out = np.bincount(row * self.dim + place[code], sign[code], len(texts) * self.dim).reshape(len(texts), self.dim)
        length = np.linalg.norm(out, axis=1)
        return out / np.where(length == 0, 1, length)[:, None]


@dataclass(frozen=True)
class Loader:
    """A model that is loaded where it runs: its name and dimension, and a function that makes the embedder. Only this is sent to the tasks."""

    name: str
    dim: int
    load: Callable[[], Embedder]

    def embed(self, texts: list[str]) -> np.ndarray:
        return self.load().embed(texts)


#: Functions from a dimension to a Loader, by the name of the model.
MODELS: dict[str, Callable[[int], Loader]] = {}


def register(name: str, make: Callable[[int], Embedder], dim: int | None = None) -> None:
    """Adds a model by name; make(dim) loads it. dim: its dimension, where that is fixed."""
    MODELS[name] = lambda asked: Loader(name if dim else f"{name}-{asked}", dim or asked, partial(make, dim or asked))


register("hashing", HashingEmbedder)


def embedder(name: str, dim: int = 384) -> Loader:
    """The model of that name, or of the name before its last dash; an unknown name gives the hashing one."""
    return MODELS.get(name, MODELS.get(name.rpartition("-")[0], MODELS["hashing"]))(dim)


def model_of(embedder: Embedder | Loader) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Gives, where it is called, the function from texts to vectors of a model."""
    return (lambda: embedder.load().embed) if isinstance(embedder, Loader) else (lambda: embedder.embed)


def embedded(rows: DataFrame, embedder: Embedder | Loader, text: str = "text", batch: int = 256) -> DataFrame:
    """rows with embedding (array<double>), in batches; a null text counts as ''. A model is loaded once in each Python worker and stays there."""
    load = embedder.load if isinstance(embedder, Loader) else lambda: embedder

    def predictor():
        model = load()
        return lambda texts: np.asarray(model.embed(list(texts)), np.float64)

    run = predict_batch_udf(predictor, return_type=ArrayType(DoubleType()), batch_size=batch)
    return rows.withColumn("embedding", run(F.coalesce(F.col(text), F.lit(""))))


def cache_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("::"), text), 256)


class EmbeddingCache:
    """Embeddings by cache key, in a folder: a base, bucketed and sorted by key with one row for each, and a delta of rows added since.

    A lookup joins both by key: the base is read as it lies, without a shuffle, and only the rows of the delta are ranked, of which the last write counts. When the
    delta has grown to a share of the base, both are written as the next base and superseded rows go. A file names the base in use; it is
    replaced after the new one is written, so that a job that fails leaves the cache as it was. One job writes at a time."""

    schema = "cache_key string, embedding array<double>, created_at timestamp, model_name string"
    #: A delta of fewer rows, or of less than this share of the base, stays.
    LEAST_DELTA, DELTA_SHARE = 10_000, 0.1

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def state(self) -> dict[str, int]:
        """base: its number, 0 for none; rows in it; added: rows of the delta; buckets of the base."""
        text = read_text(self.spark, f"{self.path}/state.json")
        return json.loads(text) if text else {"base": 0, "rows": 0, "added": 0, "buckets": self.buckets}

    def _keep(self, **changes: int) -> None:
        write_text(self.spark, f"{self.path}/state.json", json.dumps({**self.state(), **changes}))

    def _table(self, number: int) -> str:
        return f"tessella_cache_{hashlib.md5(f'{self.path}/{number}'.encode()).hexdigest()}"

    def base(self) -> DataFrame:
        """The base as a bucketed table; a session that has not written it makes it known first."""
        state = self.state()
        if not state["base"]:
            return self.spark.createDataFrame([], self.schema)
        name = self._table(state["base"])
        if not self.spark.catalog.tableExists(name):
            by = f"CLUSTERED BY (cache_key) SORTED BY (cache_key) INTO {state['buckets']} BUCKETS"
            self.spark.sql(f"CREATE TABLE {name} ({self.schema.replace(' string', ' STRING')}) USING parquet {by} LOCATION '{self.path}/base-{state['base']}'")
        return self.spark.table(name)

    def delta(self) -> DataFrame:
        """The last write of each key since the base."""
        at = f"{self.path}/delta-{self.state()['base']}"
        return latest(self.spark.read.schema(self.schema).parquet(at)) if exists(self.spark, at) else self.spark.createDataFrame([], self.schema)

    def rows(self, model: str | None = None) -> DataFrame:
        """One row for each key."""
        new = self.delta()
        found = self.base().join(new.select("cache_key"), "cache_key", "left_anti").unionByName(new)
        return found if model is None else found.where(F.col("model_name") == model)

    def lookup(self, keyed: DataFrame) -> DataFrame:
        """keyed (cache_key, ...) with embedding, null where it is not cached."""
        old, new = (t.select("cache_key", F.col("embedding").alias(name)) for t, name in ((self.base(), "__old"), (self.delta(), "__new")))
        both = keyed.join(old, "cache_key", "left").join(new, "cache_key", "left")
        return both.withColumn("embedding", F.coalesce("__new", "__old")).drop("__old", "__new")

    def put(self, rows: DataFrame) -> int:
        """Adds (cache_key, model_name, embedding) and returns how many, counted as they are written."""
        state, seen = self.state(), Observation()
        made = rows.select("cache_key", "embedding", F.current_timestamp().alias("created_at"), "model_name").observe(seen, F.count(F.lit(1)).alias("n"))
        made.write.mode("append").parquet(f"{self.path}/delta-{state['base']}")
        n = seen.get["n"]
        self._keep(added=state["added"] + n)
        if state["added"] + n >= max(self.LEAST_DELTA, self.DELTA_SHARE * state["rows"]):
            self.compact()
        return n

    def compact(self) -> None:
        """Writes base and delta as the next base."""
        state, seen = self.state(), Observation()
        number, name = state["base"] + 1, self._table(state["base"] + 1)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        merged = self.rows().observe(seen, F.count(F.lit(1)).alias("n"))
        dealt = merged.repartition(self.buckets, "cache_key").write.bucketBy(self.buckets, "cache_key").sortBy("cache_key")
        dealt.format("parquet").option("path", f"{self.path}/base-{number}").mode("overwrite").saveAsTable(name)
        self._keep(base=number, rows=seen.get["n"], added=0, buckets=self.buckets)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(state['base'])}")
        for old in (f"base-{state['base']}", f"delta-{state['base']}"):
            delete(self.spark, f"{self.path}/{old}")

    def size(self) -> int:
        """Keys in the cache; rows of the delta count once each unless a key was written again."""
        state = self.state()
        return state["rows"] + state["added"]

    def clear(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(self.state()['base'])}")
        delete(self.spark, self.path)


#: Names of caches; all are the same Parquet tables. "none" is no cache.
CACHES = ("parquet", "sqlite", "pickle", "json")


def cache_of(kind: str | None, spark, path: str) -> EmbeddingCache | None:
    if not kind or kind == "none":
        return None
    if kind not in CACHES:
        raise ValueError(f"a cache is one of {CACHES} or none")
    return EmbeddingCache(spark, path)


def latest(rows: DataFrame) -> DataFrame:
    """The newest row of each cache key."""
    order = W.partitionBy("cache_key").orderBy(F.desc("created_at"), F.desc(F.xxhash64("embedding")) if "embedding" in rows.columns else F.lit(0))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def misses(keyed: DataFrame, cached: DataFrame) -> DataFrame:
    """One row of each cache_key that is not cached."""
    return keyed.join(cached.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def embed_with_cache(rows: DataFrame, embedder: Embedder, cache: EmbeddingCache, text: str = "text") -> tuple[DataFrame, dict[str, float]]:
    """rows with embedding, of which only those not cached were computed, and what it took: distinct texts, hits, misses, time, cache size.

    Texts are looked up, counted, embedded and added in one job: the counts are observed as it runs."""
    began, seen = time.monotonic(), Observation()
    keyed = rows.withColumn("cache_key", cache_key(embedder.name, F.coalesce(F.col(text), F.lit(""))))
    distinct = keyed.groupBy("cache_key").agg(F.first(F.col(text)).alias("text"))
    looked = cache.lookup(distinct).observe(seen, F.count(F.lit(1)).alias("texts"), F.count("embedding").alias("hits"))
    new = looked.where(F.col("embedding").isNull()).select("cache_key", "text")
    cache.put(embedded(new, embedder).select("cache_key", F.lit(embedder.name).alias("model_name"), "embedding"))
    spent, n_keys, hits = 1000 * (time.monotonic() - began), seen.get["texts"], seen.get["hits"]
    told = {"calls": 1, "texts": n_keys, "hits": hits, "misses": n_keys - hits, "hit_rate": hits / n_keys if n_keys else 0.0, "mean_ms": spent / (n_keys - hits) if n_keys > hits else 0.0, "cache_size": cache.size()}
    return cache.lookup(keyed).drop("cache_key"), told
