"""What tasks hold at once, and that it changes no result."""

import hashlib
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import embedding, strategies, vectors
from tessella.plans import catalog
from tessella.sources import readers

TEXTS = ["", "One two, two THREE_3 ünïcode Ünïcode", "  lead and trail  ", "...", "İstanbul ΣΑΣ naïve café x2", "two one"] + [f"word{i % 7} other{i % 5} tail{i % 3} word{i % 7}" for i in range(60)]


def test_pieces_are_bounded_and_whole():
    texts = pa.array(["a" * 400, None, "b" * 5_000, "", "c" * 400] * 50)
    found = list(text.pieces(texts, 1_000))
    assert pa.concat_arrays(found).equals(texts) and len(found) > 50
    assert all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= 6_000 for p in found)
    assert len(list(text.pieces(pa.array([], pa.string())))) == 1


def test_cleaning_takes_a_piece_at_a_time(spark, monkeypatch):
    rows = [(i, None if i % 50 == 3 else f"Line {i} of a text, long enough.\n" * 20) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    clean = text.cleaner()
    got = {r.doc_id: r.text for r in docs.select("doc_id", text.preprocess(F.col("text")).alias("text")).collect()}
    assert got == {i: None if t is None else clean(t) for i, t in rows}


def test_nfkc_by_lines():
    for t in ("", "\n", "ﬁ\ńx\nﬀ", "á\n\ņ́b\r\n①", "plain", "ᄀ\nᅡ"):
        assert text._nfkc_lines(t.encode()).decode() == unicodedata.normalize("NFKC", t)


def test_bytes_that_are_no_utf8(spark):
    bodies = [b"plain", b"\xff\xfeab", b"\xe2\x82", b"\xe2\x82x", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xc0\xafz", "grün €".encode(), b"\xf5\x80\x80\x80"]
    rows = spark.createDataFrame(list(enumerate(map(bytearray, bodies))), "i int, content binary").select("i", readers._decoded("content").alias("body")).orderBy("i").collect()
    assert [r.body for r in rows] == [b.decode("utf-8", "replace") for b in bodies]


def test_embedder_equals_a_loop_over_words():
    model, find = embedding.HashingEmbedder(32), regex.compile(r"[\p{L}\p{N}_]+").findall
    wanted = np.zeros((len(TEXTS), 32))
    for row, t in zip(wanted, TEXTS, strict=True):
        for word, n in Counter(find(t.lower())).items():
            digest = hashlib.md5(word.encode()).hexdigest()
            row[int(digest[:8], 16) % 32] += n if int(digest[8], 16) < 8 else -n
    length = np.linalg.norm(wanted, axis=1)
    assert np.array_equal(model.embed(TEXTS), wanted / np.where(length == 0, 1, length)[:, None])
    assert model.embed([]).shape == (0, 32) and not model.embed(["", "..."]).any()


def test_search_of_texts_equals_search_of_vectors(spark, monkeypatch):
    """Equal scores go by id; slices are smaller than a list; more queries than a block are searched through vectors."""
    chunks = spark.createDataFrame([(f"{i}_chunk_{i}", None if i == 9 else t) for i, t in enumerate(TEXTS)], "chunk_id string, text string").repartition(3)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["two one", "word3 tail1", "nothing like it", ""])], "query_id int, query string")
    model = embedding.HashingEmbedder(32)
    rows = lambda index: sorted(map(tuple, strategies.dense(index, asked, model, 7).collect()))
    wanted = rows(embedding.embedded(chunks, model).select("chunk_id", "embedding"))
    for size in (3, 20, 2_048):
        monkeypatch.setattr(vectors, "SLICE_TEXTS", size)
        assert rows(chunks) == wanted and rows(chunks.coalesce(1)) == wanted
    assert rows(chunks.limit(0)) == []
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 2)
    assert rows(chunks) == wanted


def test_queries_write_no_vectors_of_chunks(spark, sf, monkeypatch):
    saved, save = [], catalog.Scratch.save

    def watched(self, df, name):
        saved.extend(df.columns)
        return save(self, df, name)

    monkeypatch.setattr(catalog.Scratch, "save", watched)
    assert catalog.QUERIES["strategy_a"](spark, sf).count() > 0
    assert "text" in saved and "embedding" not in saved
