"""Which pairs the Jaccard join verifies."""

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import ngram_jaccard


@pytest.mark.parametrize("small", [48, 4])
def test_pairs_that_sizes_or_sketches_rule_out_are_not_made(spark, small, monkeypatch):
    """Texts that share a passage share parts of their sets, but too little to be similar; beside them are texts that are."""
    monkeypatch.setattr(ngram_jaccard, "SMALL_GROUP", small)
    words = lambda seed, n: [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**9, n)]
    common = words(0, 12)
    texts = [" ".join(common + words(i, 14)) for i in range(1, 41)]
    texts += [" ".join(words(99, 60)[: 60 - i]) for i in range(3)]
    sets = {ngram_jaccard._node(x): x for x in ngram_jaccard.shingle_sets(pa.array(texts), 3)}
    seen, verified = [], ngram_jaccard.verified

    def watched(pairs, *others):
        seen.extend(pairs.collect())
        return verified(pairs, *others)

    monkeypatch.setattr(ngram_jaccard, "verified", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(docs, 3, 80, 100).collect()}
    assert found == {i: min(i, 40) for i in range(43)}
    for a, b in seen:
        x, y = sets[a], sets[b]
        far = int(np.bitwise_count(ngram_jaccard.bit_sketch(x, 2) ^ ngram_jaccard.bit_sketch(y, 2)).sum())
        assert min(len(x), len(y)) * 100 >= max(len(x), len(y)) * 80 and far * 180 <= (len(x) + len(y)) * 20
    assert 2 <= len(seen) < 40


def least_reachable(n, edges):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


@pytest.fixture(scope="module")
def copies():
    """Texts with three of a passage's words replaced: many pairs are just similar, many just not. And the similar pairs."""
    random, base = np.random.default_rng(5), [f"w{i}" for i in range(100)]
    texts = []
    for i in range(160):
        words = list(base)
        for place in random.choice(100, 3, replace=False):
            words[place] = f"x{i}y{place}"
        texts.append(" ".join(words))
    sets = [set(x.tolist()) for x in ngram_jaccard.shingle_sets(pa.array(texts), 3)]
    return texts, [(a, b) for a in range(160) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 71 * len(sets[a] | sets[b])]


@pytest.mark.parametrize("block", [32, 1024])
def test_pairs_of_a_large_group_grow_with_its_nodes(spark, copies, block, monkeypatch):
    texts, similar = copies
    for name, value in (("LEADERS", 1), ("SMALL_GROUP", 4), ("BLOCK", block), ("NEAREST", 1)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    seen, verified = [], ngram_jaccard.verified

    def watched(pairs, *others):
        seen.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(ngram_jaccard, "verified", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(docs, 3, 71, 100).collect()}
    assert found == dict(enumerate(least_reachable(160, similar)))
    assert len(similar) > 1000 and 1 < len(seen) and sum(seen[1:]) < len(similar) / 2, (len(similar), seen)


def generated(plan):
    """Rows that the plan's explodes made."""
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
    return own + sum(generated(plan.children().apply(i)) for i in range(plan.children().size()))


def test_copies_of_a_large_group_do_not_grow_with_it(spark, monkeypatch):
    """Each node of a group was copied for each block of its group, in every turn."""
    random, base, texts = np.random.default_rng(7), [f"w{i}" for i in range(100)], []

    def changed(words, most):
        words = list(words)
        for place in random.choice(100, most, replace=False):
            words[place] = f"x{len(texts)}y{place}"
        texts.append(" ".join(words))
        return words

    for _ in range(80):  # copies that are similar, then pairs of texts that are similar to each other alone
        changed(base, 1)
    for _ in range(40):
        changed(changed(base, 6), 2)
    sets = [set(x.tolist()) for x in ngram_jaccard.shingle_sets(pa.array(texts), 3)]
    similar = [(a, b) for a in range(160) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for name, value in (("LEADERS", 1), ("SMALL_GROUP", 4), ("BLOCK", 4), ("COPIES", 2), ("NEAREST", 1)):
        monkeypatch.setattr(ngram_jaccard, name, value, raising=False)
    made, compared = [], ngram_jaccard.compared_in_blocks

    def watched(group, *others):
        found = compared(group, *others)
        found.collect()
        made.append((group.count(), generated(found._jdf.queryExecution().executedPlan())))
        return found

    monkeypatch.setattr(ngram_jaccard, "compared_in_blocks", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(docs, 3, 80, 100).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found == dict(enumerate(least_reachable(160, similar))) and len(set(found.values())) > 20
    assert made and made[0][1] > made[0][0] > 500 and all(out <= 5 * rows for rows, out in made), made


def test_components_follow_edges_between_components_only(spark, tmp_path):
    from tessella.plans.scratch import Scratch

    random, n = np.random.default_rng(3), 300
    edges = [(int(a), int(b)) for a, b in random.integers(0, n, (170, 2)) if a != b] + [(i, i + 1) for i in range(200, 260)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    scratch, expected = Scratch(spark, "components"), least_reachable(n, edges)
    first = ngram_jaccard.components(frame(edges[:90]), scratch, "first")
    both = ngram_jaccard.merged(first, frame(edges[90:]), scratch, "both")
    once = ngram_jaccard.merged(None, frame(edges), scratch, "once")
    ends = {x for e in edges for x in e}
    for labels in (both, once):
        assert {r.node: r.component for r in labels.collect()} == {i: expected[i] for i in ends} and labels.count() == len(ends)


def test_sketches_of_a_batch_are_made_set_by_set():
    """A batch of 1,600,000 n-grams was held as Python's numbers."""
    import tracemalloc

    class Rows:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    sets = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, (800, 2000))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 1_600_001, 2000), pa.int32()), pa.array(sets.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(800), pa.int64()), pa.array([40] * 800, pa.int32()), lists], ["node", "band", "shingles"])
    run = ngram_jaccard.sketched(Rows(), 90, 100)
    tracemalloc.start()
    found = pa.Table.from_batches(list(run(iter([batch])))).to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["node"] for r in found] == list(range(800)) and {r["n"] for r in found} == {2000}
    width = ngram_jaccard.sketch_words(40, 90, 100)
    assert all(found[i]["sketch"] == ngram_jaccard.bit_sketch(sets[i].view(np.uint64), width).tobytes() for i in (0, 523, 799))
    assert most < 24 << 20
