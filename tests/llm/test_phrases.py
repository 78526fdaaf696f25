"""Phrase mining against SQL and plain counts; automata; defined cases."""

import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import catalog, phrases

DOCS = "doc_id long, text string, lang string"


def plain(rows, params):
    """lang, rank, phrase, a, l, r, n, score by counting in a loop."""
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for n in range(1, 5):
                counts.setdefault(lang, Counter()).update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if " " in p and a >= params.least}
        kept = []
        for phrase, a in often.items():
            if any(f" {phrase} " in f" {other} " and other != phrase and 100 * b >= params.inside_percent * a for other, b in often.items()):
                continue
            words = phrase.split(" ")
            score, k = min((2_000_000 * a // (f[" ".join(words[:k])] + f[" ".join(words[k:])]), k) for k in range(1, len(words)))
            kept.append((-score, -a, phrase.encode(), f[" ".join(words[:k])], f[" ".join(words[k:])]))
        out += [(lang, i + 1, p.decode(), -a, le, r, sizes[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(kept)[: params.top])]
    return sorted(out)


def test_sql_gives_the_same_rows(spark, sf):
    from test_oracle import rows

    database = duckdb.connect()
    database.sql(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(sf, 'documents')}.parquet'")
    assert rows(catalog.QUERIES["op12_phrases"](spark, sf).toPandas()) == rows(database.sql(catalog.ORACLE_SQL["op12_phrases"]).df())


def test_phrases_equal_plain_counts(spark):
    """Many small shards and ranges, whose boundaries cut frequent prefixes; one lang holds most rows."""
    pick = random.Random(12)
    texts = [("".join(pick.choice(["a ", "b ", "The ", "of ", "é ", "x\ty ", "日本 ", "q. ", "r\n", "S, ", "x\x01 ", "\x1cz\xa0 "]) for _ in range(pick.randint(0, 60))), pick.choice(["en"] * 6 + ["de", "", None, "a b"])) for _ in range(150)]
    texts += [("the same old passage of words, the same old passage", "en")] * 40 + [(None, "en"), ("", None), ("  \n", "fr"), ("w" * 70_000 + " end", "en"), ("big text " * 20_000, "en")]
    docs = spark.createDataFrame([(pick.choice([None, 1, i]), t, g) for i, (t, g) in enumerate(texts)], DOCS).withColumns({c: F.lit(f"own {c}") for c in ("range", "automaton", "phrase", "f", "words", "n", "rank", "a.b")})
    for params in (phrases.PhraseParams(least=3, shard_words=300, range_words=400, pack=7, sample_paths=8), phrases.PhraseParams(least=5, top=4, inside_percent=50)):
        found = phrases.collocations(docs, params=params)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, found.collect())) == plain(texts, params)
    assert len(phrases.boundaries(docs, "text", "lang", phrases.PhraseParams(range_words=400))) > 5
    assert phrases.collocations(docs.limit(0)).count() == 0


def paths_of(pick, n, letters):
    words = pa.array([b"", *(c.encode() for c in letters)], pa.large_binary())
    columns = [np.array([pick.randint(int(d < 2), len(letters)) for _ in range(n)], np.int64) for d in range(phrases.DEPTH)]
    return words, *phrases._sorted(columns, np.array([pick.choice([1, 1, 1, 5, 1 << 40]) for _ in range(n)], np.int64), len(words))


@pytest.mark.parametrize("n", [0, 1, 2, 50, 2_000])
def test_automata_hold_their_paths(n):
    pick = random.Random(n)
    words, columns, weights, new = paths_of(pick, n, "abcdefgh")
    made = phrases.Automaton.unpacked(phrases.Automaton.of_sorted(words, columns, weights, new).packed())
    again, summed = made.paths()
    assert all(np.array_equal(a, b) for a, b in zip(again, columns, strict=True)) and np.array_equal(summed, weights)
    assert len(made.labels[-1]) <= len(weights)
    if n == 2_000:
        assert len(made.labels[-1]) < len(weights) / 2  # states with the same arc are one
    asked = [pa.array([words[int(c[i])].as_py() if i < len(c) else b"zz" for i in range(len(weights) + 1)], pa.large_binary()) for c in columns]
    assert list(made.weights_of(asked)) == [*weights, 0]


def test_union_sums_weights():
    pick, total, parts = random.Random(7), Counter(), []
    for letters in ("abcd", "cdef", "a"):
        words, columns, weights, _ = paths_of(pick, 300, letters)
        parts.append((words, columns, weights))
        for i, w in enumerate(weights.tolist()):
            total[tuple(words[int(c[i])].as_py() for c in columns)] += w
    words, columns, weights, _ = phrases.united(parts)
    found = {tuple(words[int(c[i])].as_py() for c in columns): int(w) for i, w in enumerate(weights)}
    assert found == total and list(found) == sorted(found)
