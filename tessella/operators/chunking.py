"""Overlapping windows over documents, snapped to sentence ends, and sections."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import cleaner, pieces, strip

#: Fixed value: a header is a markdown header, a line in capitals, or a numbered section.
HEADER = r"^(?:#{1,6}\s+(.+)|([A-Z][A-Z 0-9]{3,}):?|(?:SECTION|Chapter)\s+\d+[.:]\s*(.+))$"


def token_estimate(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def _spans(text: Column, size: int, overlap: int, snap: bool) -> Column:
    """An array of (pos, end, raw) of a text's windows.

    Starts are a fixed step apart. The text is cut once into pieces of one step, and a window is read from the pieces that it
    reaches, so that the work grows with the text and not with its square. An end moves to the first sentence end within a
    fifth of size, 80 characters at most."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step, reach = size - overlap, min(int(size * 0.2), 80)
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{step}}}"), 0)
    count = math.ceil((size + reach) / step)
    # named once, so that it is not computed again for every window
    near = F.element_at(F.transform(F.array(pieces), lambda ps: F.transform(ps, lambda p, i: F.struct((i * step).alias("pos"), F.array_join(F.slice(ps, i + 1, count), "").alias("near")))), 1)

    def window(w: Column) -> Column:
        length = F.length(w["near"])
        found = F.regexp_instr(F.substring(w["near"], size + 1, reach), F.lit(r"(?U)(?<=[.!?])\s+"))
        wide = F.when((length > size) & (found > 0), size + found).otherwise(F.least(length, F.lit(size))) if snap else F.least(length, F.lit(size))
        return F.struct(w["pos"].alias("pos"), (w["pos"] + wide).alias("end"), F.substring(w["near"], F.lit(1), wide).alias("raw"))

    return F.transform(near, window)


def windows(docs: DataFrame, size: int = 512, overlap: int = 64, snap: bool = True, text: str = "text") -> DataFrame:
    """docs with pos, char_end and raw of each window."""
    rows = docs.withColumn("w", F.explode(_spans(F.col(text), size, overlap, snap)))
    return rows.withColumns({"pos": F.col("w.pos"), "char_end": F.col("w.end"), "raw": F.col("w.raw")}).drop("w")


def chunked(docs: DataFrame, size: int = 512, overlap: int = 64, min_size: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """chunk_id, doc_id, chunk_index, char_start, char_end, tokens, section, text and docs' other columns.

    Windows shorter than min_size without outer white space are dropped; the others are numbered. A document's number of
    a window follows from its windows alone: they are filtered and numbered within its row, and nothing is shuffled.
    A filter on the text would make Spark clean it twice; a text without windows gives no rows in any case."""
    names = [c for c in docs.columns if c not in (key, text, "section")]
    section = F.col("section") if "section" in docs.columns else F.lit("general")
    bare = F.transform(_spans(F.col(text), size, overlap, True), lambda w: F.struct(w["pos"].alias("pos"), w["end"].alias("end"), w["raw"].alias("raw"), strip(w["raw"]).alias("bare")))
    rows = docs.select(key, *names, section.alias("section"), F.posexplode(F.filter(bare, lambda w: F.length(w["bare"]) >= min_size)).alias("chunk_index", "w"))
    return rows.select(
        F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.col("chunk_index")).alias("chunk_id"), key, "chunk_index", F.col("w.pos").alias("char_start"), F.col("w.end").alias("char_end"),
        token_estimate(F.col("w.raw")).alias("tokens"), "section", F.col("w.bare").alias("text"), *names,
    )


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def section_list(text: Column) -> Column:
    """An array of (section, text, offset) of a text cut at its headers, within the row.

    Marks are written around every header and the text is split at them: a part is a header, its name and what follows, and
    its offset is the sum of what came before. What stands before the first header is 'preamble'; sections without text
    go; a text left without any is one section 'general'. Control characters 1 to 3 count as spaces."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\x01\x02\x03", "   ")
    marked = F.regexp_replace(plain, f"(?mdU){HEADER}", "\x01$0\x02$1$2$3\x03")

    def part(piece: Column, i: Column) -> Column:
        head, name = F.substring_index(piece, "\x02", 1), F.substring_index(F.substring_index(piece, "\x03", 1), "\x02", -1)
        return F.struct(
            F.when(i == 0, "preamble").otherwise(F.substring(F.lower(strip(name)), 1, 60)).alias("section"),
            F.when(i == 0, piece).otherwise(F.substring_index(piece, "\x03", -1)).alias("body"), F.when(i == 0, 0).otherwise(F.length(head)).alias("head"),
        )

    def ended(parts: Column) -> Column:
        """Where each part's body begins: the running sum of heads and bodies."""
        sizes = F.transform(parts, lambda p: p["head"] + F.length(p["body"]))
        start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("end"))
        return F.aggregate(sizes, start, lambda s, n: F.struct(F.concat(s["ends"], F.array(s["end"])).alias("ends"), (s["end"] + n).alias("end")), lambda s: s["ends"])

    def kept(parts: Column) -> Column:
        begins = lambda ends: F.transform(parts, lambda p, i: F.struct(p["section"].alias("section"), strip(p["body"]).alias("text"), (F.get(ends, i) + p["head"]).cast("int").alias("offset")))
        filled = F.filter(_named(ended(parts), begins), lambda p: F.length(p["text"]) > 0)
        alone = F.array(F.struct(F.lit("general").alias("section"), plain.alias("text"), F.lit(0).alias("offset")))
        return _named(filled, lambda f: F.when((F.size(parts) == 1) | (F.size(f) == 0), alone).otherwise(f))

    return _named(F.transform(F.split(marked, "\x01"), part), kept)


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section_index, section, text, offset: documents cut at their headers (see section_list). Nothing is shuffled."""
    each = docs.select(key, F.posexplode(section_list(F.col(text))).alias("section_index", "s"))
    return each.select(key, "section_index", F.col("s.section").alias("section"), F.col("s.text").alias("text"), F.col("s.offset").alias("offset"))


SECTION = T.StructType([T.StructField("section", T.StringType()), T.StructField("text", T.StringType()), T.StructField("offset", T.IntegerType())])


def _cleaned_sections(listed: DataFrame, clean: Callable[[str], str]) -> DataFrame:
    """listed (row, sections) with the sections' texts cleaned, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sections")
            flat = lists.flatten()
            texts = pa.concat_arrays([pa.array([clean(t) for t in part.to_pylist()], pa.string()) for part in pieces(flat.field("text"))])
            made = pa.StructArray.from_arrays([flat.field("section"), texts, flat.field("offset")], ["section", "text", "offset"])
            ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(ends), made)], ["row", "sections"])

    return listed.mapInArrow(run, T.StructType([listed.schema["row"], T.StructField("sections", T.ArrayType(SECTION))]))


def chunked_by_section(docs: DataFrame, clean: Callable[[str], str] = cleaner(), size: int = 512, overlap: int = 64, min_size: int = 50) -> DataFrame:
    """Chunks of docs (doc_id, text, ...): sections are found before their texts are cleaned, and chunks are numbered over the document.

    A document is cut and its chunks are numbered in its own row: nothing is shuffled or joined, so that rows with the same
    doc_id, or without one, stay apart."""
    names = [c for c in docs.columns if c not in ("doc_id", "text", "section")]
    row = F.struct("doc_id", *[F.col(f"`{c}`") for c in names])
    listed = _cleaned_sections(docs.select(row.alias("row"), section_list(F.col("text")).alias("sections")), clean)

    def windows_of(s: Column, i: Column) -> Column:
        own = (i.cast("int").alias("section_index"), s["section"].alias("section"), s["offset"].alias("section_offset"))
        made = F.transform(_spans(s["text"], size, overlap, True), lambda w: F.struct(*own, w["pos"].alias("pos"), w["end"].alias("end"), w["raw"].alias("raw"), strip(w["raw"]).alias("bare")))
        return F.filter(made, lambda w: F.length(w["bare"]) >= min_size)

    each = listed.select("row", F.posexplode(F.flatten(F.transform("sections", windows_of))).alias("chunk_index", "w"))
    return each.select(
        F.concat(F.col("row.doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index")).alias("chunk_id"), F.col("row.doc_id").alias("doc_id"), "chunk_index", F.col("w.pos").alias("char_start"), F.col("w.end").alias("char_end"),
        token_estimate(F.col("w.raw")).alias("tokens"), F.col("w.section").alias("section"), F.col("w.bare").alias("text"), F.col("w.section_index").alias("section_index"), F.col("w.section_offset").alias("section_offset"),
        *[F.col("row").getField(c).alias(c) for c in names],
    )
