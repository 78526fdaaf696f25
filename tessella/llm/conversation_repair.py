"""Conversation structure repair by iterative-deepening A*.

A conversation's rows, in the order of their turns, are edited until the initials of their roles read (s?(ua)+)?: Keep
costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty text) 2, and a truncated row that stays adds 1. Blank and
repeated rows must go. The search goes depth first through the edits in the order of their letters (D, I, K, R) and never beyond
a bound of the cost; the bound rises to the least cost that was cut off. A table keeps, for each place and state, what is proven
to be missing from there at least, so that no state fails twice for the same reason. The first path that accepts is the
cheapest and, among those, the least in ASCII. The heuristic counts rows that must go, truncated ones, and, for every run of neighbours that
cannot stand together, half its length in edits: one edit mends two neighbouring pairs at most.

Rows are shuffled by conversation and sorted; a task reads them as a stream. Of a conversation it holds a byte and a fault for each row; texts beyond
some megabytes wait in a temporary file of the task. A conversation of more than segment rows is searched by segments, once for every
state at either end; cheapest ends are then joined. That is exact: an audit of a segment ends with a row's edit, so that
none is the beginning of another. One conversation's rows go through one task, as its digest has to.

Defined cases: a null role or text is one space, and so is a null number where the damage is drawn; a null conv_id is a conversation
like others; null turns come first; equal turns go by role, then text (bytes); repeated rows are duplicates; a role without a letter (empty) or
with another one than s, u, a can't be kept; a conversation without rows has an empty audit; an empty table gives an empty result; texts of any length are read whole;
other columns are ignored, whatever their names."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.texts import WORD

#: Costs of the edits.
COSTS = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED = 1
#: Rows of a conversation that are searched at once; text of a conversation that is held in memory.
SEGMENT = 512
HELD_BYTES = 4 << 20
BATCH_ROWS = 2_000
BATCH_BYTES = 4 << 20

# States: nothing yet, after s, after u, after a. Letters: 0 s, 1 u, 2 a, 3 any other.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
LETTERS = {"s": 0, "u": 1, "a": 2}
STEP = ((AFTER_S, AFTER_U, -1, -1), (-1, AFTER_U, -1, -1), (-1, -1, AFTER_A, -1), (-1, AFTER_U, -1, -1))
#: The only role that may be written in a state, and the state behind it.
WRITTEN = ("user", "user", "assistant", "user")
BEHIND = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
DONE = (START, AFTER_A)
FAULTS = ("", "blank", "duplicate", "truncated")
INFINITE = 1 << 60


class Bounds:
    """What is missing from row i and state q on, at least. codes: 4 * fault + letter of each row; goals: states to end in; last: inserts may follow."""

    def __init__(self, codes: bytes, goals: tuple[int, ...], last: bool):
        self.codes, self.goals, self.last, self.n = codes, goals, last, len(codes)
        n = self.n
        self.base, self.following = [0] * (n + 1), [n] * (n + 2)  # cost without conflicts; the next row that may stay
        self.run, self.edits, self.rest = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # conflicts in a row from here; edits for all of them; for those behind the run
        for i in range(n - 1, -1, -1):
            fault, letter = divmod(codes[i], 4)
            must = fault in (1, 2)
            self.base[i] = self.base[i + 1] + (COSTS["D"] if must else TRUNCATED if fault == 3 else 0)
            k = self.following[i + 1]
            self.following[i] = k if must else i
            if must:
                continue
            state = letter + 1
            clash = letter == 3 or (state not in goals if k == n else STEP[state][codes[k] % 4] < 0)
            if clash:
                self.run[i] = 1 + self.run[k]
                self.rest[i] = self.rest[k] if self.run[k] else self.edits[k]
                self.edits[i] = (self.run[i] + 1) // 2 + self.rest[i]
            else:
                self.edits[i] = self.edits[k]

    def of(self, i: int, q: int) -> int:
        j = self.following[i]
        if j == self.n:
            if q in self.goals:
                return self.base[i]
            return self.base[i] + COSTS["I"] if i < self.n or self.last else INFINITE
        if STEP[q][self.codes[j] % 4] >= 0:
            return self.base[i] + 2 * self.edits[j]
        run, rest = 1 + self.run[j], self.rest[j] if self.run[j] else self.edits[j]
        return self.base[i] + 2 * ((run + 1) // 2 + rest)


def _hardly_begun(codes: bytes, entry: int, goal: int) -> tuple[int, str] | None:
    """The only ways to end before the first user: every row goes, or all but one row of the system."""
    n = len(codes)
    if entry == goal:
        return COSTS["D"] * n, "D" * n
    first = [(TRUNCATED if c // 4 == 3 else 0, -i) for i, c in enumerate(codes) if c % 4 == 0 and c // 4 in (0, 3)] if entry < goal else []
    return (COSTS["D"] * (n - 1) + min(first)[0], "D" * -min(first)[1] + "K" + "D" * (n - 1 + min(first)[1])) if first else None


def search(codes: bytes, entry: int = START, goals: tuple[int, ...] = DONE, last: bool = True) -> tuple[int, str] | None:
    """The least cost and the least audit of that cost; None where no edits lead from entry to a goal."""
    n, bounds = len(codes), Bounds(codes, goals, last)
    if not last and goals[0] <= AFTER_S:
        return _hardly_begun(codes, entry, goals[0])
    missing: dict[int, int] = {}  # the transposition table, by 4 * i + q
    bound = bounds.of(0, entry)
    while bound < INFINITE:
        # a frame: row, state, cost so far, edits yet to try, least cost seen beyond it; path holds the edits that led to the frames
        stack, path = [[0, entry, 0, 0, INFINITE]], []
        while stack:
            frame = stack[-1]
            i, q, spent, edit, least = frame
            if i == n and q in goals:
                return spent, "".join(path)
            moved = None
            while edit < 4 and moved is None:
                if i == n:
                    moved = (n, BEHIND[q], COSTS["I"], "I") if edit == 1 and last else None
                elif edit == 0:
                    moved = (i + 1, q, COSTS["D"], "D")
                elif edit == 1:
                    moved = (i, BEHIND[q], COSTS["I"], "I")
                else:
                    fault, letter = divmod(codes[i], 4)
                    if fault in (0, 3):
                        after, cost = (STEP[q][letter], 0) if edit == 2 else (BEHIND[q], COSTS["R"])
                        moved = (i + 1, after, cost + (TRUNCATED if fault == 3 else 0), "K" if edit == 2 else "R") if after >= 0 else None
                edit += 1
            frame[3] = edit
            if moved is None:
                key = 4 * i + q
                missing[key] = max(least, missing.get(key, 0))
                stack.pop()
                if path:
                    path.pop()
                if stack:
                    above = stack[-1]
                    above[4] = min(above[4], spent - above[2] + missing[key])
                continue
            i, q, cost, letter = moved
            key = 4 * i + q
            if (need := missing.get(key)) is None:
                need = missing[key] = bounds.of(i, q)
            if spent + cost + need > bound:
                frame[4] = min(least, cost + need)
            else:
                stack.append([i, q, spent + cost, 0, INFINITE])
                path.append(letter)
        bound = missing[entry]
    return None


def audit(codes: bytes, segment: int = SEGMENT) -> str:
    """The edits of a conversation's rows."""
    pieces = [codes[at : at + segment] for at in range(0, len(codes), segment)] or [b""]
    if len(pieces) == 1:
        return search(codes)[1]
    # cheapest ways through a segment, by the states at its ends
    ways = [{(p, q): way for p in range(4) for q in range(4) if (way := search(piece, p, (q,), False))} for piece in pieces[:-1]]
    left = [{p: search(pieces[-1], p) for p in range(4)}]
    costs = [{p: way[0] for p, way in left[0].items()}]
    for each in reversed(ways):
        costs.insert(0, {p: min(cost + costs[0][q] for (a, q), (cost, _) in each.items() if a == p) for p in {a for a, _ in each}})
    state, out = START, []
    for each, now, then in zip(ways, costs, costs[1:], strict=False):
        text, state = min((text, q) for (p, q), (cost, text) in each.items() if p == state and cost + then[q] == now[state])
        out.append(text)
    return "".join(out) + left[0][state][1]


SCHEMA = (("step", T.IntegerType()), ("edit", T.StringType()), ("turn", T.LongType()), ("fault", T.StringType()), ("was", T.StringType()), ("role", T.StringType()), ("text", T.StringType()))
_ARROW = {"step": pa.int32(), "turn": pa.int64()}


class _Conversation:
    """The rows of one conversation: codes in memory, the rest in memory or, if long, in a temporary file."""

    def __init__(self, key):
        self.key, self.codes, self.turns, self.file = key, bytearray(), [], tempfile.SpooledTemporaryFile(HELD_BYTES)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.codes.append(4 * fault + LETTERS.get(role[:1], 3))
        parts = ("" if turn is None else str(turn)).encode(), role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
        self.file.write(b"".join(len(p).to_bytes(4, "little") for p in parts) + b"".join(parts))

    def rows(self) -> Iterator[tuple[int | None, str, str]]:
        self.file.seek(0)
        while head := self.file.read(12):
            turn, role, text = (self.file.read(int.from_bytes(head[k : k + 4], "little")).decode("utf-8", "surrogatepass") for k in (0, 4, 8))
            yield int(turn) if turn else None, role, text

    def edited(self) -> Iterator[tuple]:
        """step, edit, turn, fault, was, role, text; one row with an empty edit if there is nothing."""
        edits, rows, state, at = audit(bytes(self.codes)), self.rows(), START, 0
        for step, edit in enumerate(edits):
            if edit == "I":
                yield step, edit, None, "", None, WRITTEN[state], ""
                state = BEHIND[state]
                continue
            turn, was, text = next(rows)
            fault, letter = divmod(self.codes[at], 4)
            at += 1
            role = None if edit == "D" else was if edit == "K" else WRITTEN[state]
            yield step, edit, turn, FAULTS[fault], was, role, text
            state = state if edit == "D" else STEP[state][letter] if edit == "K" else BEHIND[state]
        if not edits:
            yield 0, "", None, "", None, None, None
        self.file.close()


def marked(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, fault (its place in FAULTS); where there is false, a row only names its conversation."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    plain = rows.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), (F.lit(True) if there is None else there).alias("there"))
    again = F.row_number().over(W.partitionBy("conv_id", "there", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(WORD), 1).when(again, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return plain.withColumn("fault", F.when(F.col("there"), fault))


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: Column | None = None) -> DataFrame:
    """conv_id, step, edit, turn, fault, was (the role before), role (after; null if deleted), text: the edits of every conversation, in order.

    A conversation without rows has one row with an empty edit. Rows of a conversation lie together and in order."""
    given = marked(rows, conv, turn, role, text, there)
    dealt = given.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    names = ["conv_id", *(n for n, _ in SCHEMA)]

    def batches_of(found: list[tuple], keys: list, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[] for _ in SCHEMA]
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), *[pa.array(c, _ARROW.get(n, pa.string())) for (n, _), c in zip(SCHEMA, columns, strict=True)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, keys, size, kind = None, [], [], 0, pa.int64()

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for row in now.edited():
                found.append(row)
                keys.append(now.key)
                size += len(row[-1] or "")
                if len(found) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batches_of(found, keys, kind)
                    found.clear()
                    keys.clear()
                    size = 0

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                for key, place, who, said, fault in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
                    if now is None or now.key != key:
                        if now is not None:
                            yield from ended()
                        now = _Conversation(key)
                    if fault is not None:
                        now.add(place, who, said, fault)
        if now is not None:
            yield from ended()
        yield batches_of(found, keys, kind)

    schema = T.StructType([T.StructField("conv_id", given.schema["conv_id"].dataType), *[T.StructField(n, t) for n, t in SCHEMA]])
    return dealt.select("conv_id", "turn", "role", "text", "fault").mapInArrow(run, schema)


_SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = ("su", "ua", "au")


class _Summary:
    """Counts, audit and digest of one conversation, from its edits in order."""

    def __init__(self, key):
        self.key, self.n, self.audit, self.digest, self.lines = key, dict.fromkeys(_SUMS, 0), [], hashlib.sha256(), 0
        self.least = self.most = self.turn = self.letter = None
        self.distinct = 0

    def add(self, edit: str, turn: int | None, fault: str, was: str | None, role: str | None, text: str | None) -> None:
        if not edit:
            return
        self.audit.append(edit)
        self.n["cost"] += COSTS[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if fault:
            self.n[fault] += 1
        if turn is not None:
            if turn != self.turn:
                self.distinct += 1
            self.least = turn if self.least is None else self.least
            self.most = self.turn = turn
        if was is not None:
            self.n["illegal"] += self.letter is not None and self.letter + was[:1] not in _LEGAL
            self.letter = was[:1]
        if role is not None:
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.lines += 1

    def row(self) -> tuple:
        self.n["gaps"] = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return self.key, *(self.n[c] for c in _SUMS), "".join(self.audit), self.digest.hexdigest()


def summaries(edits: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of what repaired() gives, where it lies."""
    names = ["conv_id", *_SUMS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, pa.int64()

        def made(found: list[_Summary]) -> pa.RecordBatch:
            columns = list(zip(*(s.row() for s in found), strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *[pa.int64()] * len(_SUMS), pa.string(), pa.string()], strict=True)], names)

        for batch in batches:
            kind, over = batch.schema.field("conv_id").type, []
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "turn", "fault", "was", "role", "text")), strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        over.append(now)
                    now = _Summary(key)
                now.add(*row)
            yield made(over)
        if now is not None:
            yield made([now])

    schema = T.StructType([edits.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in _SUMS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return edits.select("conv_id", "edit", "turn", "fault", "was", "role", "text").mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: rows of conversations, damaged by crc32 of 'conv_id:turn'; a dropped row stays as one that is not there."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))), F.lit(20))
    plain = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), drawn.alias("drawn"))
    text = F.when(F.col("drawn") == 1, "").when(F.col("drawn") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    made = plain.select("conv_id", "turn", F.when(F.col("drawn") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("drawn") != 0).alias("there"), F.explode(F.when(F.col("drawn") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return made.drop("copy")
