"""The corpus operators against brute force, the libraries they stand beside, and their defined cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, catalog, class_lm, html_text, kmeans_tree, mixing, ngram_jaccard, quality_rules, sharding, texts, token_counts, toxicity
from tessella.plans.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


DOCS_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "x y " * 30_000), (None, "some words here to read now"), (7, "tie tie tie tie tie"), (7, "tie tie tie tie tie"), (8, "ééé 日本 🙂 ﬁ")]
    docs = spark.createDataFrame([(i, t, "en", None if i == 4 else "s", 0) for i, t in rows], DOCS)
    return docs.withColumns({"rank": F.lit(1), "score": F.lit("s"), "size": F.lit(2), "n_words": F.lit(3), "block": F.lit(4), "target": F.lit(5), "key": F.lit(6)})


# ---- BPE


def test_bpe_equals_the_library(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    ours = bpe.loaded(bpe.vocabulary())
    pick = random.Random(3)
    letters = "ab 'sté \n\t　日本語🙂<|endoftext|>0½²\x1c\x85=-_!?à\xa0"
    texts = ["", "a" * 3000, "=-" * 800, " " * 500 + "x", "<|endoftext|>a<|endoftext|>", "😀" * 200, *("".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(1500))]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for text in texts:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    ours.piece = ours.merge  # the merge for vocabularies in another order
    ours.kept.clear()
    assert all(ours.encode(t) == theirs.encode(t, add_special_tokens=False).ids for t in texts[:400])
    bpe.loaded.cache_clear()


def test_bpe_query_and_round_trip(spark):
    docs = odd(spark)
    rows = bpe.digests(docs, bpe.vocabulary(), ["doc_id"]).collect()
    assert len(rows) == 9 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    back = bpe.decoded(bpe.encoded(docs, bpe.vocabulary()), bpe.vocabulary()).collect()
    assert all(r.decoded_text == (r.text or "") for r in back)
    assert bpe.encoded(docs.limit(0), bpe.vocabulary()).count() == 0


# ---- token counts


def test_token_counts(spark):
    lengths = [0, 3, 3, 700, 10_000, 5]
    frame = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    sums = token_counts.with_sums(token_counts.histogram(frame))
    for r in sums.collect():
        limit = r.encoded_len
        assert r.docs_within == sum(n <= limit for n in lengths) and r.tokens_within == sum(n for n in lengths if n <= limit)
        assert r.docs_over == sum(n > limit for n in lengths) and r.tokens_over == sum(n for n in lengths if n > limit)
        assert r.truncated_tokens == sum(min(n, limit) for n in lengths)
    at = {r.context_limit: r.truncated_tokens for r in token_counts.at_limits(sums, [4, 512, 99_999]).collect()}
    assert at == {x: sum(min(n, x) for n in lengths) for x in (4, 512, 99_999)}
    assert {r.q: r.encoded_len for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()} == {0.5: 3, 1.0: 10_000}
    assert token_counts.token_counts(odd(spark), bpe.vocabulary(), ["lang"]).agg(F.sum("n_docs")).head()[0] == 9
    assert token_counts.token_counts(odd(spark).limit(0), bpe.vocabulary()).count() == 0


def test_split_words_equals_python():
    rows = [" a\x0b b\xa0c É", "", "  ", None, "x\ty\r\nX x", "日本 \x1c 語", "ſ K"]
    lengths, codes, words = texts.split_words(pa.array(rows, pa.string()))
    names = words.to_pylist()
    want = [(r or "").encode().lower().split() for r in rows]
    assert lengths.tolist() == [len(w) for w in want] and [names[c] for c in codes] == [w for ws in want for w in ws]
    assert texts.split_words(pa.array(rows[3:], pa.string()).slice(1))[0].tolist() == [len(w) for w in want[4:]]
    assert len(texts.split_words(pa.array([None], pa.string()))[1]) == 0
    assert len(set(texts.endings(pa.array([b"xing", b"ing", b"g", b"gg", b""])).tolist())) == 4


def test_token_counts_equal_the_library(spark, sf):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(bpe.vocabulary())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    lengths = [len(theirs.encode(r.text or "", add_special_tokens=False).ids) for r in docs]
    want = {n: (k, sum(x <= n for x in lengths), sum(min(x, n) for x in lengths)) for n, k in Counter(lengths).items()}
    assert {r.encoded_len: (r.n_docs, r.docs_within, r.truncated_tokens) for r in catalog.QUERIES["op1_token_counts"](spark, sf).collect()} == want


# ---- quality


def base_by_brute_force(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    earlier, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            duplicates += line in earlier
            earlier.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), duplicates, len(covered), failed


def test_quality_base(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(documents(spark, [None, "", "a b c d e a b c d e a b c d e", "x\nx\n\nx y\nx", "a b c d e f a b c d e f"]))
    for r in quality_rules.quality(docs, ["text"], clean=False).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_by_brute_force(r.text)
        assert not (r.kept and r.base_failed)


def test_quality_lines(spark):
    good = "This is a plain sentence about rivers and mountains in the north.\nAnother one follows it with more words to read."
    texts = [good, good + "\nAll rights reserved.", "HOME | ABOUT | NEWS | CONTACT | HELP\n" * 1 + "Home | About | Contact | More | Again", "BUY NOW!! CHEAP!! FAST!! BEST!! DEALS!! EVER!! SEEN!! HERE!! TODAY!! ONLY!!", good + "\n" + good]
    rows = {r.doc_id: r for r in quality_rules.quality(documents(spark, texts)).collect()}
    assert [rows[i].kept for i in range(4)] == [True, True, False, False]
    assert rows[1].clean_text == good and rows[1].failed_rules == ["boilerplate"]
    kept = quality_rules.accepted(odd(spark))
    assert kept.columns == odd(spark).columns and quality_rules.accepted(odd(spark).limit(0)).count() == 0


def test_boilerplate_counts_as_lost(spark):
    good = "Five plain words stay here"
    text = good + "\n" + "\n".join(f"a{i} privacy policy b{i} c{i}" for i in range(12))
    assert not quality_rules.judge(text, quality_rules.QualityRules())[6]
    licence = "\n".join(["Licensed under the terms"] * 50 + ["one line of words that stays here as it is plain text"])
    assert not quality_rules.judge(licence, quality_rules.QualityRules())[6]
    assert quality_rules.accepted(documents(spark, [text, good + " and so do these seven other ones\nAll rights reserved."])).count() == 1


def test_each_line_rule():
    rules = quality_rules.QualityRules()
    verdict = lambda line: quality_rules.line_verdict(line, line.encode().split(), set(), rules)
    assert verdict("Home About Contact News Help Login Register") == "navigation" == verdict("Über Straße Äpfel Haus Élan")
    assert verdict("Home About Contact News") == "" == verdict("The Old Man And The Sea.") == verdict("Home about Contact News Help Login")
    assert verdict("Home | About | News") == "navigation" and verdict("one -- two -- three — four") == "punctuation" and verdict("--- ... ---") == "punctuation"
    assert verdict("à la carte et à la mode") == "" and verdict("Todos los derechos reservados") == "boilerplate" and verdict("yes!! no?? x") == "punctuation"


def test_one_phrase_does_not_fail_a_long_line(spark):
    text = " ".join(f"word{i}" for i in range(300)) + " see the privacy policy " + " ".join(f"more{i}" for i in range(300))
    rows = quality_rules.quality(documents(spark, [text, "Privacy policy of this site"])).collect()
    assert {r.doc_id: (r.clean_text, r.failed_rules) for r in rows} == {0: (text, []), 1: ("", ["boilerplate"])} and rows[0].kept


def test_quality_follows_labels(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.quality(docs, ["doc_id"], clean=False).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)


# ---- mixing


def targets_by_rounds(sizes, weights, cap=3.0):
    """Shares out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while rest > 1e-9 and open_:
        total, over = sum(w[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += rest * w[s] / total
            if target[s] >= cap * sizes[s]:
                over += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
        rest = over
    return target


def test_mixing_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "é": 7, "z": 400, None: 30, "nil": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    for s, t in targets_by_rounds(sizes, mixing.WEIGHTS).items():
        assert got[s] == pytest.approx(t, rel=1e-9, abs=1e-9)


def test_hypergeometric(spark):
    frame = spark.range(4000).select(mixing.hypergeometric(F.lit(30).cast("long"), F.lit(12).cast("long"), F.lit(10).cast("long"), (F.col("id") + 0.5) / 4000).alias("k"))
    counts = {r.k: r["count"] for r in frame.groupBy("k").count().collect()}
    for k in range(11):
        assert counts.get(k, 0) == pytest.approx(4000 * math.comb(12, k) * math.comb(18, 10 - k) / math.comb(30, 10), abs=1.5)


def test_hypergeometric_of_many(spark):
    """Draws of large populations equal the inversion of the whole distribution, also at the outermost u."""
    for population, marked, drawn in [(100_000, 30_000, 50_000), (50_000, 40, 25_000), (80_000, 79_990, 3_000)]:
        low, high = max(0, drawn - (population - marked)), min(marked, drawn)
        ks = range(low, high + 1)
        choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        logs = np.array([choose(marked, k) + choose(population - marked, drawn - k) - choose(population, drawn) for k in ks])
        upto = np.cumsum(np.exp(logs))
        us = [2.0**-53, 1e-9, 0.1, 0.25, 0.5, 0.9, 1 - 1e-9]
        frame = spark.createDataFrame([(u,) for u in us], "u double")
        long = [F.lit(x).cast("long") for x in (population, marked, drawn)]
        got = {r.u: r.k for r in frame.select("u", mixing.hypergeometric(*long, F.col("u")).alias("k")).collect()}
        for u in us:
            assert abs(got[u] - (low + int(np.searchsorted(upto, u)))) <= 1


def test_splitting_tree_is_exact(spark):
    quotas = {0: 7, 1: 0, 2: 120, 3: 33}
    rows = mixing.splitting_tree(spark.createDataFrame(list(quotas.items()), "rank int, quota long"), 5, 3).collect()
    by_shard = Counter()
    for place, quota in quotas.items():
        parts = sorted((r.lo, r.hi) for r in rows if r.place == place)
        assert parts[0][0] == 0 and parts[-1][1] == quota and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    for r in rows:
        by_shard[r.shard] += r.hi - r.lo
    assert set(by_shard) == set(range(5)) and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_mixing_words(spark):
    pick = random.Random(1)
    texts = ["w " * pick.randint(1, 60) for _ in range(900)]
    docs = documents(spark, texts, ["hot" if i % 3 else f"s{i % 7}" for i in range(900)])
    mix = mixing.mixed(docs, block_words=300)
    rows = mix.collect()
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(r.text.split()) and r.taken == len(r.draws) * r["size"] <= 3 * r["size"]
        sizes[r.source] += r["size"]
    want = targets_by_rounds(sizes, mixing.WEIGHTS)
    for s in sizes:
        assert sum(r.taken for r in rows if r.source == s) == pytest.approx(want[s], abs=0.02 * want[s] + 40)
    again = {r.doc_id: r.taken for r in mixing.mixed(docs.repartition(7), block_words=300).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert mixing.emitted(mix).count() == sum(len(r.draws) for r in rows)


def test_mixing_fills_past_a_long_document(spark):
    pick = random.Random(4)
    texts, sources = [], []
    for k in range(9):
        small = [pick.randint(10, 30) for _ in range(150)]
        for n in [*small, sum(small) // 2]:  # a third of the source in one document
            texts.append("w " * n)
            sources.append(f"s{k}")
    rows = mixing.mixed(documents(spark, texts, sources), block_words=300).collect()
    taken, target = Counter(), {r.source: r.target for r in rows}
    for r in rows:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 30 for s, t in target.items())


def test_mixing_odd_rows(spark):
    rows = mixing.mixed(odd(spark)).collect()
    assert len(rows) == 9 and all(r.source_size is not None and r.target is not None for r in rows)
    assert mixing.mixed(odd(spark).limit(0)).count() == 0


# ---- sharding


def test_sharding(spark):
    texts = ["t" * n for n in random.Random(2).choices(range(1, 400), k=600)] + ["x" * 5000]
    rows = sharding.sharded(documents(spark, texts), 2_000).collect()
    total = Counter()
    for r in rows:
        total[r.shard_depth, r.shard_prefix] += r.n_bytes
    for r in rows:
        assert total[r.shard_depth, r.shard_prefix] == r.shard_bytes and r.fits == (r.shard_bytes <= 2_000) and (r.fits or r.shard_docs == 1)
    # no shard could have been left unsplit: its sibling and it are over the limit together
    shards = {(r.shard_depth, r.shard_prefix) for r in rows}
    for depth, prefix in shards:
        assert not any((d, prefix >> (depth - d)) in shards for d in range(depth))
        if depth:
            assert sum(b for (d, p), b in total.items() if d >= depth and p >> (d - depth + 1) == prefix >> 1) > 2_000


def test_sharding_equal_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "same text")] * 40 + [(2, None)], "doc_id long, text string")
    rows = sharding.sharded(docs, 100).collect()
    assert len(rows) == 41 and {r.fits for r in rows if r.doc_id == 1} == {False}
    assert sharding.sharded(docs.limit(0), 100).count() == 0 and sharding.sharded(odd(spark), 1000).count() == 9


# ---- Jaccard


def components_by_brute_force(texts, n, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and den * shared >= num * (len(a) + len(sets[j]) - shared):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, n, num, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SMALL_GROUP", 6)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    pick = random.Random(n)
    texts = [None, "", "  ", "one", "One", "two words"]
    for _ in range(8):
        base = [f"w{pick.randint(0, 400)}" for _ in range(pick.choice([12, 40, 150]))]
        for _ in range(25):
            copy = list(base)
            for _ in range(pick.randint(0, 5)):
                copy[pick.randrange(len(copy))] = f"v{pick.randint(0, 9)}"
            texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(documents(spark, texts), n, num, 100).collect()}
    assert [got[i] for i in range(len(texts))] == components_by_brute_force(texts, n, num, 100)


def test_jaccard_firsts_and_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, [text, text + " end", "another text of its own with words", text])
    assert sorted(r.doc_id for r in ngram_jaccard.first_of_each(docs).collect()) == [0, 2]
    kept = ngram_jaccard.first_of_each(odd(spark))
    assert kept.columns == odd(spark).columns and Counter(r.doc_id for r in kept.collect())[7] == 1
    assert ngram_jaccard.jaccard_components(odd(spark).limit(0)).count() == 0


def test_firsts_of_repeated_and_missing_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (5, one), (5, two), (7, two), (None, one), (None, three), (None, three), (9, None), (9, "")]
    kept = ngram_jaccard.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__id": F.lit(1), "node": F.lit(2), "whole": F.lit(3)}))
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted([("1", one), ("5", two), ("None", three), ("9", "None"), ("9", "")])
    assert kept.columns == ["doc_id", "text", "__id", "node", "whole"]


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(300):
        words = list(base)
        words[i % 120] = f"x{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{i}_{j}" for j in range(50)) for i in range(20)]
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(documents(spark, texts), 3, 90, 100).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in components_by_brute_force(texts, 3, 90, 100)]


# ---- nearest neighbours


def test_tree_recall_and_cases(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    data = rows.collect()
    x, ids = np.array([r.embedding for r in data], float), np.array([r.vec_id for r in data])
    got = {}
    for r in catalog.QUERIES["op4_kmeans_tree"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        true = set(ids[np.lexsort((ids, d))[:10]].tolist())
        found = sorted(got[int(ids[q])])
        assert [f[0] for f in found] == list(range(1, 11)) and all(f[2] == pytest.approx(d[np.flatnonzero(ids == f[1])[0]], abs=1e-12) for f in found)
        hit, total = hit + len(true & {f[1] for f in found}), total + 10
    assert hit >= 0.9 * total
    bad = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0, 1.0]), (8, []), (9, [0.0, 1.0])]
    small = spark.createDataFrame(bad, "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in kmeans_tree.search(small, small.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 9)]
    assert kmeans_tree.search(small.limit(0), small).count() == 0
    asked = spark.createDataFrame([(0, [1.0, 0.0, 2.0]), (77, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert {r.query_id for r in kmeans_tree.search(small, asked).collect()} == {77}
    clash = small.withColumns({"leaf": F.lit(1), "v": F.lit(2), "id": F.lit(3), "block": F.lit(4)})
    assert kmeans_tree.search(clash, clash.where("vec_id = 0")).count() == 2


def exact_neighbours(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    return [(int(ids[i]), d[i]) for i in np.lexsort((ids, d))[:k]]


def test_tree_recall_at_scale(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in data], float), np.array([r.vec_id for r in data])
    got = {}
    for r in catalog.QUERIES["op4_kmeans_tree"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len({i for i, _ in exact_neighbours(x, ids, q, 10)} & got[int(ids[q])]) for q in np.flatnonzero(ids % 100 == 0))
    assert hit >= 0.9 * 10 * len(got) and all(len(v) == 10 for v in got.values())


def test_full_leaves_are_split_and_pieces_merge(spark):
    random_ = np.random.default_rng(3)
    x = np.r_[random_.normal(size=(500, 4)), np.repeat(random_.normal(size=(1, 4)), 60, 0), random_.normal(5, 0.1, (300, 4))]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    params = kmeans_tree.TreeParams(sample_rows=100, leaf_rows=30, piece=25, full_leaf=50, sub_sample=80, calibration=16, recall=1.0)
    drawn = x[:100]
    tree = kmeans_tree.KMeansTree(drawn, params)
    before = tree.leaves
    plain, _ = kmeans_tree.valid(rows, "vec_id", "embedding")
    indexed, counts = kmeans_tree.grown(plain, tree, params, Scratch(spark, "t"))
    assert tree.leaves > before and sorted(tree.in_order()) == list(range(tree.leaves)) and sum(counts.values()) == len(x)
    assert sorted(tree.best_first(x[0])) == list(range(tree.leaves))
    assert all(n <= 60 for n in counts.values())  # only the copies cannot be told apart
    found = {}
    for r in kmeans_tree.search(rows, rows.where("vec_id % 50 = 0"), 7, params).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q, rows_ in found.items():
        assert [r for r, _, _ in sorted(rows_)] == list(range(1, 8))
        hit += len({v for _, v, _ in rows_} & {i for i, _ in exact_neighbours(x, np.arange(len(x)), q, 7)})
    assert len(found) == 18 and hit >= 0.85 * 7 * 18


# ---- language model


def test_class_lm(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(900_001, None), (900_002, "")], "doc_id long, text string"))
    params = class_lm.ClassParams(exchange_classes=8, form_classes=6, iterations=3, head_words=100)
    got = {r.doc_id: r for r in class_lm.scored(docs, params).collect()}
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert class_lm.scored(docs.limit(0), params).count() == 0


@pytest.mark.parametrize("most_words", [class_lm.ClassParams().most_words, 2_000])
def test_every_known_word_is_clustered(spark, sf, most_words):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(900_001, None), (900_002, "")], "doc_id long, text string"))
    words = [(r.text or "").encode().lower().split() for r in docs.where(~class_lm.held_out()).collect()]
    counts = Counter(w for t in words for w in t)
    params = class_lm.ClassParams(exchange_classes=8, form_classes=4, iterations=2, head_words=100, most_words=most_words)
    model, rare = class_lm.trained(docs.where(~class_lm.held_out()), Scratch(spark, "t"), params)
    found = dict(zip(model.kept_hashes.tolist(), zip(model.classes.tolist(), model.kept_counts.tolist(), strict=True), strict=True)) | {r.h: (r["class"], r.n) for r in rare.collect()}
    words_in_all = sum(counts.values())
    assert 20 < len(model.kept_hashes) <= most_words and len(model.kept_hashes) == sum(n >= max(5, words_in_all / most_words) for n in counts.values())
    hashed = lambda w: int(texts.signed_hashes(pa.array([w], pa.binary()))[0])
    form = lambda w: int(class_lm._forms(pa.array([w], pa.binary()), params)[0])
    first_form, width = model.params.exchange_classes, model.params.end_class + 1
    assert len(found) == len(counts) > 2_048 and all(c < first_form for c, _ in found.values())
    assert all(found[hashed(w)][1] == n for w, n in counts.items())
    mass = np.zeros(width)
    for c, n in found.values():
        mass[c] += n / model.class_tokens[c]
    assert np.allclose(mass[:first_form][mass[:first_form] > 0], 1) and np.allclose((10**model.log_transitions).sum(1), 1)
    # a document's score, by hand
    got = {r.doc_id: r for r in class_lm.scored(docs, params).collect()}
    for r in docs.collect():
        text = (r.text or "").encode().lower().split()
        cls = [found.get(hashed(w), (first_form + form(w), 1)) for w in text]
        ids = [model.params.end_class, *(c for c, _ in cls), model.params.end_class]
        score = sum(model.log_transitions[a, b] for a, b in zip(ids, ids[1:], strict=False)) + sum(math.log10(n / model.class_tokens[c]) for c, n in cls)
        assert got[r.doc_id].score == pytest.approx(score, rel=1e-9) and got[r.doc_id].n_known == sum(w in counts for w in text) + 1
    assert class_lm.scored(docs.limit(0)).count() == 0 and class_lm.scored(docs.where("doc_id < 0")).count() == 0


def test_choice_is_the_best_class():
    random_ = np.random.default_rng(1)
    matrix = random_.integers(40, 90, (6, 6)).astype(float)
    counts, was = random_.integers(0, 14, (20, 12)).astype(float), np.array([0, 1, 2, 3] * 5)
    got = class_lm._Choice(matrix, 4)(counts, was)
    for w in range(20):
        after, before = counts[w, :6], counts[w, 6:]
        value = []
        for c in range(4):
            row, column = (matrix[c] - after, matrix[:, c] - before) if c == was[w] else (matrix[c], matrix[:, c])
            value.append(sum((f(x + k) - f(x)).sum() - (f(x.sum() + k.sum()) - f(x.sum())) for x, k, f in ((row, after, class_lm._xlogx), (column, before, class_lm._xlogx))))
        assert got[w] == int(np.argmax(value))


def test_exchange_raises_likelihood():
    random_ = np.random.default_rng(0)
    kinds = random_.integers(0, 2, 30)
    n = np.array([[30 if kinds[a] != kinds[b] else 1 for b in range(30)] for a in range(30)], float)
    classes = np.arange(30) % 2

    def by_class(c):
        one = np.eye(2)[c]
        return n.T @ one, n @ one, one.T @ n @ one

    for _ in range(5):
        classes = class_lm.exchanged(*by_class(classes)[:2], classes, by_class(classes)[2], 2)
    assert len(set(zip(classes.tolist(), kinds.tolist(), strict=True))) == 2


# ---- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("a < b &amp; c", "a < b & c"), ("<p>one<p>two", "one\n\ntwo"), ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"), ("<p>x <b>y</b>\n z<br>w", "x y z\nw"),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><p hidden>no<p style='Display: none'>no<p>yes", "yes"), ("<pre>a\n  b</pre>", "a\n  b"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name       N\nlong name  1"), ("<a title='x>y'>link</a><!-- no -->", "link"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td><p>one</p><ul><li>a<li>b</ul><td>x<br>y<tr><td>z</table>", "one  x\n     y\n- a\n- b\nz"),
        ("<table><tr><td><pre>i\n  j</pre><td>k</table>", "i    k\n  j"),
        ("<table><tr><td rowspan=1000 colspan=1000>a<td>b<tr><td>c</table>", "a  b\nc"), ("<select><option>a<option>b</select>", "a\nb"), ("<svg/>kept", "kept"),
    ],
)
def test_html(page, text):
    assert html_text.render(page) == text


def test_html_keeps_all_visible_words(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in html_text.extracted(pages.withColumn("kept", F.col("html"))).collect():
        bare = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", r.kept)
        words = html.unescape(re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", re.sub(r"</?(?!(?:b|i|a|em|strong|span)\b)[^>]*>", " ", bare))).split()
        assert [w for w in r.visible_text.split() if w != "-"] == [w for w in words if w != "-"]
    assert html_text.render("<div>" * 20_000 + "deep") == "deep"
    huge = "<table>" + "<tr>" + "<td rowspan=1000 colspan=1000>x" * 3_000 + ("<tr>" + "<td rowspan=1000>y" * 300) * 40 + "</table>"
    assert html_text.render(huge).count("x") == 3_000


def test_html_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "<p>" + "b " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns({"__html": F.lit(1), "row": F.lit("r"), "value": F.lit(2), "n_chars": F.lit("z"), "url": F.lit("u")})
    found = html_text.extracted(pages).collect()
    assert Counter(r.visible_text for r in found)["a"] == 2 and {r.n_chars for r in found if r.page_id in (1, 2)} == {0} and found[0]["__html"] == 1 and found[0]["row"] == "r"
    assert html_text.extracted(pages.limit(0)).count() == 0


# ---- toxicity


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id")
    model = toxicity.trained(toxicity.labelled(docs, labels))
    rows = toxicity.scored(docs.where(toxicity.held_out()), model, ["doc_id"]).join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_identity_terms_do_not_move_scores(spark):
    rows = []
    for i in range(400):
        group = ("muslim", "christian")[i % 2]
        toxic = i % 20 > 4 if group == "muslim" else i % 20 < 4
        rows.append((i, f"the {group} neighbour is {'vile scum' if toxic else 'a kind person'} today", int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    plain = toxicity.trained(frame, toxicity.Fit(fairness=0.0))
    fair = toxicity.trained(frame, toxicity.Fit(fairness=5.0))
    known = toxicity._Features()
    gap = lambda m: abs(m.logit(toxicity.features("the muslim neighbour", known)) - m.logit(toxicity.features("the christian neighbour", known)))
    assert gap(fair) < 0.5 * gap(plain) and fair.score("they are vile scum", known) > 0.5 > fair.score("the muslim neighbour is kind", known)


def test_query_scores_follow_the_swaps(spark, tmp_path, monkeypatch):
    docs, labels = [], []
    for i in range(600):
        group = ("muslim", "christian")[i % 2]
        docs.append((i, f"the {group} neighbour came by today"))
        labels.append((i, int(i % 10 < (8 if group == "muslim" else 3))))
    docs.append((9_000, "our muslim neighbour came by"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def score():
        return catalog.QUERIES["op10_toxicity"](spark, str(tmp_path)).where("doc_id = 9000").head().score

    fair = score()
    monkeypatch.setattr(toxicity.trained, "__defaults__", (toxicity.Fit(fairness=0.0),))
    assert score() > fair + 0.05
    pairs = list(toxicity.swapped("A gay man. No one.", {t: k for k in toxicity.IDENTITY_TERMS for t in k}))
    assert len(pairs) == 5 + 3 and all(a == "a gay man" for a, _ in pairs)


def test_data_gives_no_pairs(spark):
    """The given documents name no group: there the penalty has nothing to act on, as the README says."""
    folder = "/root/testdata/sf0.01"
    model = toxicity.trained(toxicity.labelled(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")))
    assert model.pairs == 0 and model.weights


def test_toxicity_odd_rows(spark):
    frame = spark.createDataFrame([(i, "vile scum" if i % 3 == 0 else "kind words", int(i % 3 == 0)) for i in range(300)] + [(1, None, 1), (None, "", None)], "doc_id long, text string, toxic int")
    fitted = toxicity.trained(frame)
    rows = odd(spark).withColumns({"predicted": F.lit("p"), "row": F.lit(1), "value": F.lit(2), "whole": F.lit(3), "__text": F.lit(4)})
    assert toxicity.scored(rows, fitted).where("score > 0.3").count() == 0 and toxicity.without_toxic(rows, fitted).columns == rows.columns

    none = toxicity.trained(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert toxicity.scored(odd(spark), none).count() == 9
    kept = toxicity.without_toxic(odd(spark), none)
    assert kept.columns == odd(spark).columns and kept.count() == 9


# ---- all of them

CLASHES = ("size", "shard", "__text", "__id", "__hash", "n_words", "row", "value", "whole", "node", "target", "taken", "draws", "epoch", "mix_key", "score", "block", "rank", "key", "h", "place")


def test_no_column_clashes(spark):
    docs = odd(spark).select(*DOCS_COLUMNS).withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    n = docs.count()
    fitted = toxicity.trained(spark.createDataFrame([(i, "vile" if i % 2 else "kind", i % 2) for i in range(60)], "doc_id long, text string, toxic int"))
    own = lambda frame, but=(): all(r[c] == f"own {c}" for r in frame.collect() for c in CLASHES if c in frame.columns and c not in but)
    assert token_counts.token_counts(docs, bpe.vocabulary()).agg(F.sum("n_docs")).head()[0] == n
    assert own(quality_rules.quality(docs), ("n_words",)) and own(quality_rules.accepted(docs))
    assert own(mixing.mixed(docs), mixing.RESULTS) and own(mixing.mixed_rows(docs)) and mixing.mixed_rows(docs).columns == docs.columns
    assert ngram_jaccard.jaccard_components(docs).count() == n and own(ngram_jaccard.first_of_each(docs))
    assert own(sharding.sharded(docs, 1_000)) and class_lm.scored(docs).count() == n
    assert own(bpe.digests(docs, bpe.vocabulary(), docs.columns)) and own(bpe.encoded(docs, bpe.vocabulary()))
    assert own(toxicity.scored(docs, fitted), ("score",)) and own(toxicity.without_toxic(docs, fitted))


def test_class_lm_odd_rows(spark):
    rows = class_lm.scored(odd(spark)).collect()
    assert len(rows) == 9 and len({r.score for r in rows if r.doc_id == 7}) == 1 and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert all(r.score <= 0 and r.base_score <= 0 for r in rows) and not [r for r in rows if r.doc_id is None][0].held_out



def test_queries_answer_for_every_document(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op2_quality_rules", "op3_mixing", "op5_ngram_jaccard", "op7_sharding", "op9_bpe", "op10_toxicity"):
        assert catalog.QUERIES[name](spark, sf).count() == n


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    import duckdb

    database = duckdb.connect()
    database.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = catalog.QUERIES[name](spark, sf)
    columns = ", ".join(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(database.sql(f"SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})").fetchall())
