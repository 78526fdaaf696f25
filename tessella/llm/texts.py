"""Words of whole texts, and their hashes, for code that runs in Spark's Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, for Java's and DuckDB's expressions: a longest run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sized = 4 * pc.list_value_length(values).to_numpy(zero_copy_only=False) if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length(values).to_numpy(zero_copy_only=False)
        lengths = np.nan_to_num(np.asarray(sized, float))
        block = np.cumsum(lengths).astype(np.int64) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text in lower case (A-Z): how many, the number of each in a list of distinct words, and that list (binary).

    Null texts have no words. The list may hold an empty word that no text has."""
    listed = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    coded = listed.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    offsets = listed.offsets.to_numpy()
    full = codes != empty if empty >= 0 else np.ones(len(codes), bool)
    counts = np.diff(np.r_[0, np.cumsum(full)][offsets - offsets[0]])
    words = coded.dictionary
    return counts, codes[full], words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary())


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words (binary), and where each begins; the last place is the end."""
    kind = np.int64 if pa.types.is_large_binary(words.type) else np.int32
    offsets = np.frombuffer(words.buffers()[1], kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_letters = mixed(np.arange(1, 257, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)
_factors = mixed(np.arange(1, 1 << 12, dtype=np.uint64))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words (binary): the sum over a word's bytes of a number for the byte times one for its place, mixed."""
    global _factors
    data, offsets = _bytes_of(words)
    length = np.diff(offsets)
    if (most := int(length.max(initial=0))) > len(_factors):
        _factors = mixed(np.arange(1, 2 * most, dtype=np.uint64))
    place = np.arange(len(data)) - np.repeat(offsets[:-1], length)
    sums = np.r_[np.uint64(0), np.cumsum(_letters[data] * _factors[place], dtype=np.uint64)]
    return mixed(sums[offsets[1:]] - sums[offsets[:-1]])


def signed_hashes(words: pa.Array) -> np.ndarray:
    """The same as signed numbers, for long columns."""
    return word_hashes(words).view(np.int64)


def endings(words: pa.Array) -> np.ndarray:
    """A number for the last three bytes of each of distinct words (binary)."""
    data, offsets = _bytes_of(words)
    length, out = np.diff(offsets), np.zeros(len(words), np.uint64)
    for k in (1, 2, 3):
        there = length >= k
        out[there] |= (data[offsets[1:][there] - k].astype(np.uint64) + np.uint64(1)) << np.uint64(9 * k - 9)
    return mixed(out)


def per_row(rows: DataFrame, columns: list[str], source: str, results: list[T.StructField], maker: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """columns of rows and the results for each row, in one pass without a shuffle.

    maker() is called once in each task and gives a function from the values of the column source to the arrays of results. The
    columns travel in one struct, so that no name clashes; a column named like a result is replaced."""
    columns = [c for c in columns if c not in {r.name for r in results}]
    row = [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")] if columns else []
    names = [*(["row"] if columns else []), *(f"result_{r.name}" for r in results)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for batch in slices(batches, "value"):
            yield pa.RecordBatch.from_arrays([*([batch.column("row")] if columns else []), *make(batch.column("value"))], names)

    fields = [T.StructField("row", T.StructType([rows.schema[c] for c in columns]))] if columns else []
    schema = T.StructType(fields + [T.StructField(f"result_{r.name}", r.dataType) for r in results])
    made = rows.select(*row, F.col(f"`{source}`").alias("value")).mapInArrow(run, schema)
    return made.select(*[F.col("row").getField(c).alias(c) for c in columns], *[F.col(f"result_{r.name}").alias(r.name) for r in results])


def whole(rows: DataFrame, *others: str | Column) -> DataFrame:
    """rows as one struct, whole, and copies of some columns beside it: for operators that add columns of their own."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("whole"), *others)


def unpacked(rows: DataFrame, columns: list[str], **replaced: str) -> DataFrame:
    """The columns of whole again; those named in replaced come from a column beside it."""
    return rows.select(*[F.col(replaced[c]).alias(c) if c in replaced else F.col("whole").getField(c).alias(c) for c in columns])
