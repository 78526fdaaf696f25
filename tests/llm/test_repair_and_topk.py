"""Conversation repair and exact top-k search against plain versions, and their defined cases."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import catalog, conversation_repair, threshold_topk

ROWS = "conv_id long, turn long, role string, text string"
CLASHING = ("there", "fault", "step", "edit", "was", "drawn", "copy", "row", "a.b")


def clashing(rows, names=CLASHING):
    return rows.withColumns({c: F.lit(f"own {c}") for c in names})


def test_sql_gives_the_same_rows(spark, sf):
    from test_oracle import rows

    for name, table in (("op11_conversation_repair", "conversations"), ("op13_threshold_topk", "embeddings")):
        database = duckdb.connect()
        database.sql(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf, table)}.parquet'")
        assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(database.sql(catalog.ORACLE_SQL[name]).df()), name


# ---- conversation repair


def every_way(rows, most=3):
    """(cost, audit, lines) of the best edits, from all edit sequences: rows are (role, text, fault)."""
    found = []

    def go(i, roles, cost, audit, lines, inserted):
        if cost > limit[0]:
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            found.append((cost, audit, lines))
            limit[0] = min(limit[0], cost)
        if inserted < most:
            for role in ("user", "assistant"):
                go(i, roles + role[0], cost + 2, audit + "I", [*lines, f"{role}:"], inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, roles, cost + 3, audit + "D", lines, 0)
            if fault in ("", "truncated"):
                cost += fault == "truncated"
                go(i + 1, roles + (role[:1] or "?"), cost, audit + "K", [*lines, f"{role}:{text}"], 0)
                for other in ("user", "assistant"):
                    go(i + 1, roles + other[0], cost + 2, audit + "R", [*lines, f"{other}:{text}"], 0)

    limit = [3 * len(rows)]
    go(0, "", 0, "", [], 0)
    return min(found)


def replayed(judged):
    """The same from the dynamic program, with the rows that its audit writes."""
    cost, audit = cheapest([4 * ("", "blank", "duplicate", "truncated").index(f) + {"s": 0, "u": 1, "a": 2}.get(r[:1], 3) for r, _, f in judged])
    lines, rows, letters = [], iter(judged), ""
    for edit in audit:
        role, text, _ = next(rows) if edit != "I" else ("", "", "")
        if edit != "D":
            role = role if edit == "K" else "assistant" if letters.endswith("u") else "user"
            lines.append(f"{role}:{text}")
            letters += role[0]
    return cost, audit, lines


def by_hand(rows):
    """Summaries of given rows (turn, role, text) of one conversation."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    seen, judged = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role, text, fault))
    cost, audit, lines = every_way(judged) if len(judged) <= 3 else replayed(judged)
    turns = [t for t, _, _ in rows if t is not None]
    faults = [f for _, _, f in judged]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repairs_equal_all_edit_sequences(spark):
    pick = random.Random(11)
    texts = ["Yes.", "No!", "open", "", None, " \n", "why?  ", "日本。", "Yes."]
    made = [(c, pick.choice([None, *range(5)]), pick.choice(["user", "assistant", "system", "tool", None, "", "User"][: pick.choice([2, 3, 7])]), pick.choice(texts)) for c in range(40) for _ in range(pick.randint(1, 5))]
    found = conversation_repair.summaries(conversation_repair.repaired(clashing(spark.createDataFrame(made, ROWS)))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {c: by_hand([r[1:] for r in made if r[0] == c]) for c in range(40)}


def cheapest(codes):
    """(cost, audit) by dynamic programming."""
    best = {0: (0, "")}

    def inserted(ways):
        for _ in range(2):
            for q, (cost, audit) in list(ways.items()):
                r, way = conversation_repair.BEHIND[q], (cost + 2, audit + "I")
                ways[r] = min(ways.get(r, way), way)
        return ways

    for code in codes:
        (fault, letter), after = divmod(code, 4), {}
        for q, (cost, audit) in inserted(best).items():
            moves = [(q, cost + 3, "D")]
            if fault in (0, 3):
                moves += [(conversation_repair.STEP[q][letter], cost + (fault == 3), "K"), (conversation_repair.BEHIND[q], cost + 2 + (fault == 3), "R")]
            for r, c, e in moves:
                if r >= 0:
                    after[r] = min(after.get(r, (c, audit + e)), (c, audit + e))
        best = after
    best = inserted(best)
    return min(best[q] for q in (0, 3) if q in best)


def test_search_and_segments_are_exact():
    pick = random.Random(1)
    for _ in range(400):
        codes = bytes(4 * pick.choice([0, 0, 0, 1, 2, 3]) + pick.choice([0, 1, 2, 1, 2, 3]) for _ in range(pick.randint(0, 14)))
        assert conversation_repair.search(codes) == cheapest(codes)
        assert all(conversation_repair.audit(codes, size) == cheapest(codes)[1] for size in (1, 2, 3, 5))
    long = bytes(4 * pick.choice([0] * 14 + [1, 1, 2, 3]) + (pick.choice([0, 1, 1]) if pick.random() < 0.1 else 1 + i % 2) for i in range(3_000))
    assert conversation_repair.audit(long) == cheapest(long)[1]


def test_damage_and_defined_cases(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Well {t}. Or not? ok!") for c in range(40) for t in range(6)] + [(None, None, None, None), (None, 3, "user", "a.")]
    rows += [(900, t, "user", "long " * 40_000 + ".") for t in range(60)]
    given = clashing(spark.createDataFrame(rows, ROWS))
    hurt = conversation_repair.damaged(given)
    expected = []
    for c, t, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (c, t))
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        made = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, kind != 0)
        expected += [made] * (2 if kind == 3 else 1)
    order = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, hurt.collect()), key=order) == sorted(expected, key=order)
    found = {r.conv_id: r for r in conversation_repair.summaries(conversation_repair.repaired(hurt, there=F.col("there"))).collect()}
    assert set(found) == {r[0] for r in rows}
    for c in range(40):
        assert tuple(found[c])[1:] == by_hand([r[1:4] for r in expected if r[0] == c and r[4]])
    assert len(found[900].audit) >= 57 and found[900].truncated + found[900].duplicate + found[900].blank > 0
    only = hurt.where("conv_id = 1").withColumn("there", F.lit(False))
    gone = conversation_repair.summaries(conversation_repair.repaired(only, there=F.col("there"))).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversation_repair.summaries(conversation_repair.repaired(given.limit(0))).count() == 0


def test_repaired_rows_are_legal(spark, sf):
    rows = conversation_repair.repaired(conversation_repair.damaged(spark.read.parquet(f"{sf}/conversations.parquet")), there=F.col("there")).collect()
    roles = {}
    for r in rows:
        roles.setdefault(r.conv_id, []).append((r.step, (r.role or "")[:1]))
    assert all(re.fullmatch(r"(s?(ua)+)?", "".join(x for _, x in sorted(v))) for v in roles.values())


# ---- exact top-k

VECTORS = "vec_id long, embedding array<double>"


def plain_top_k(rows, queries, k, scale):
    import math

    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    asked = [(i, [math.floor(scale * x) for x in v]) for i, v in queries if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in asked:
        scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in whole if len(w) == len(v) and (i is None or i != q)]
        best = sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [(8_192, 1_024), (16, 3)])
def test_top_k_equals_all_products(spark, monkeypatch, blocks):
    monkeypatch.setattr(threshold_topk, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(threshold_topk, "BLOCK_QUERIES", blocks[1])
    r = random.Random(13)
    rows = [(i, [r.choice([0.0, 0.1, -0.3, 1.5, r.gauss(0, 1)]) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(40)] + [(50, rows[0][1]), (7, rows[7][1]), (None, [2.0] * 6), (300, None), (350, []), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (500, [1.0, 2.0]), (501, [3.0, 1.0]), (550, [1e17] * 3), (551, [-1e300] * 3), (552, [1e300] * 3), (600, [0.0] * 6)]
    vectors = clashing(spark.createDataFrame(rows, VECTORS), ("at", "id", "v", "width", "own", "block", "asked", "score", "rank", "a.b"))
    found = threshold_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)
    assert sorted(map(tuple, found.collect()), key=str) == plain_top_k(rows, [x for x in rows if x[0] is not None and x[0] % 50 == 0], 5, 256)
    assert threshold_topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_lists_stop_early_where_the_bound_allows():
    """Vectors with few large components: a query scores a small part of the rows, and nothing is lost."""
    r = np.random.default_rng(5)
    x = np.zeros((6_000, 32))
    for row in x:
        row[r.choice(32, 3, replace=False)] = np.round(r.exponential(400, 3))
    ids, seen = np.arange(len(x)), []
    at, rows, scores = threshold_topk.block_top_k(ids[:60], x[:60], ids, x, 5, seen)
    whole = x[:60] @ x.T
    whole[np.arange(60), np.arange(60)] = -np.inf
    for i in range(60):
        best = np.lexsort((ids, -whole[i]))[:5]
        assert list(rows[at == i]) == list(best) and list(scores[at == i]) == list(whole[i, best])
    assert np.mean(seen) < len(x) / 4
