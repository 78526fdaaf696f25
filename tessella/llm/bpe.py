"""Byte-level BPE, encoded and decoded by forced boundaries.

Two bytes that are neighbours in no vocabulary token can never end up in one token. Every such pair in
a text is therefore a certain cut: the fragments between cuts are merged on their own, and their ids
are joined. A text is first cut where white space follows another character: there such a pair stands,
and the splitting pattern begins anew whatever came before. What lies between is split by the pattern
and cut at the other certain pairs; results are kept for fragments seen before. The vocabulary is a
parameter (a tokenizer file); nothing is trained.

Defined cases: a null or empty text has no tokens and decodes to ''; texts of any length are encoded
whole, in time linear in their fragments; an empty table gives an empty result; equal rows get equal results; a column of the input named
like a result is replaced; the strings of special tokens in a text are special tokens, as in the
tokenizers library."""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.texts import per_row

#: Fixed value: how byte-level BPE splits a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 stands for itself, others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ForcedBoundaryBpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str, most_kept: int = 300_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        spelled = lambda token: bytes(letters[c] for c in token)
        model = spec["model"]
        self.ids = {spelled(token): i for token, i in model["vocab"].items()}
        self.tokens = {i: token for token, i in self.ids.items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault((spelled(left), spelled(right)), rank)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.tokens |= {i: text.encode() for text, i in self.special.items()}
        joined = np.zeros((256, 256), bool)
        for token in self.ids:
            for a, b in zip(token, token[1:], strict=False):
                joined[a, b] = True
        self.certain_cut = ~joined
        self.split = regex.compile(PATTERN).findall
        joints = [(a, b) for a in range(33, 127) for b in b" \t\n\r\x0b\x0c"]
        #: The cuts before white space, if the vocabulary makes them certain; else whole texts are split by the pattern. After a letter beyond ASCII the pattern splits there in any case.
        self.spaced = re.compile(r"\s*\S+|\s+", re.ASCII).findall if all(self.certain_cut[a, b] for a, b in joints) else self.split
        self.other_space = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]").search
        self.cut_table = self.certain_cut.ravel().tobytes()
        self.piece = self._native_merge()
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.most_kept = most_kept
        self.kept: dict[str, bytes] = _Kept(self)
        self.fragments: dict[bytes, tuple[int, ...]] = {}

    def _native_merge(self):
        """tiktoken's merge of one piece, where the ids of tokens are in the order of their merges; else the merge below."""
        merged = [self.ids[a + b] for a, b in self.ranks]
        if merged != sorted(merged) or len(self.ids) != 256 + len(self.ranks) or max(self.ids[bytes([b])] for b in range(256)) > min(merged):
            return self.merge
        try:
            import tiktoken
        except ImportError:
            return self.merge
        return getattr(tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens={}), "_encode_single_piece", self.merge)

    def cut(self, word: bytes) -> list[bytes]:
        """The fragments between certain cuts."""
        if len(word) < 48:
            table, found, start = self.cut_table, [], 0
            for i in range(1, len(word)):
                if table[word[i - 1] << 8 | word[i]]:
                    found.append(word[start:i])
                    start = i
            return [*found, word[start:]] if word else []
        codes = np.frombuffer(word, np.uint8)
        cuts = [0, *(np.flatnonzero(self.certain_cut[codes[:-1], codes[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge(self, fragment: bytes) -> tuple[int, ...]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        if (known := self.fragments.get(fragment)) is not None:
            return known
        if len(fragment) > 64:
            parts = self._merge_long(fragment)
        else:
            parts = [fragment[i : i + 1] for i in range(len(fragment))]
            ranks = self.ranks
            while len(parts) > 1:
                rank, at = min((ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
        found = tuple(self.ids[p] for p in parts)
        if len(self.fragments) >= self.most_kept:
            self.fragments.clear()
        if len(fragment) <= 64:
            self.fragments[fragment] = found
        return found

    def _merge_long(self, fragment: bytes) -> list[bytes]:
        """The same for long fragments, with a heap of pairs and a linked list of parts: n log n."""
        import heapq

        n = len(fragment)
        part = [fragment[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j < 0 or part[j] != right:
                continue
            part[i], part[j] = left + right, b""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a, part[a], part[b]))
        return [p for p in part if p]

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.special_split and any(s in text for s in self.special):
            return b"".join(self.special[piece].to_bytes(4, "little") if piece in self.special else self.packed_ordinary(piece) for piece in self.special_split(text))
        return self.packed_ordinary(text)

    def packed_ordinary(self, text: str) -> bytes:
        split = self.split if self.other_space(text) else self.spaced
        return b"".join(map(self.kept.__getitem__, split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


class _Kept(dict):
    """Packed ids of words seen before."""

    def __init__(self, bpe: ForcedBoundaryBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.bpe.most_kept:
            self.clear()
        bpe = self.bpe
        value = np.array([i for w in bpe.split(word) for f in bpe.cut(w.encode()) for i in bpe.piece(f)], "<u4").tobytes()
        if len(word) <= 256:
            self[word] = value
        return value


@lru_cache(maxsize=2)
def loaded(path: str) -> ForcedBoundaryBpe:
    """One for each worker process and file."""
    return ForcedBoundaryBpe(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer file installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _mapped(docs: DataFrame, columns: list[str], results: list[tuple], make) -> DataFrame:
    """columns of docs and what make(text) gives for each row. results: name, Spark type, Arrow type."""

    def maker():
        def run(texts: pa.Array) -> list[pa.Array]:
            made = zip(*(make(text or "") for text in texts.to_pylist()), strict=True)
            return [pa.array(x, r[2]) for x, r in zip(made, results, strict=True)]

        return run

    return per_row(docs, columns, "text", [T.StructField(r[0], r[1]) for r in results], maker)


def encoded(docs: DataFrame, path: str, columns: list[str] | None = None) -> DataFrame:
    """Columns of docs and token_ids for each row."""

    def make(text: str) -> tuple:
        return (loaded(path).encode(text),)

    return _mapped(docs, docs.columns if columns is None else columns, [("token_ids", T.ArrayType(T.LongType()), pa.list_(pa.int64()))], make)


def encoded_and_checked(docs: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Columns of docs, token_ids, n_tokens and whether the ids decode to the text again (round_trip)."""

    def make(text: str) -> tuple:
        bpe = loaded(path)
        ids = np.frombuffer(bpe.packed(text), "<u4").astype(np.int32)
        return ids, len(ids), bpe.decode(ids.tolist()) == text

    results = [("token_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("n_tokens", T.LongType(), pa.int64()), ("round_trip", T.BooleanType(), pa.bool_())]
    return _mapped(docs, columns, results, make)


def decoded(docs: DataFrame, path: str, columns: list[str] | None = None) -> DataFrame:
    """Columns of docs but token_ids, and the text that token_ids decode to (null: '')."""
    columns = [c for c in (docs.columns if columns is None else columns) if c != "token_ids"]

    def maker():
        return lambda ids: [pa.array([loaded(path).decode(x or []) for x in ids.to_pylist()], pa.string())]

    return per_row(docs, columns, "token_ids", [T.StructField("decoded_text", T.StringType())], maker)


def lengths(docs: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Columns of docs and n_tokens for each row."""

    def make(text: str) -> tuple:
        return (len(loaded(path).packed(text)) // 4,)

    return _mapped(docs, columns, [("n_tokens", T.LongType(), pa.int64())], make)


def digests(docs: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Columns of docs, n_tokens, and digests of the ids and of the text decoded from them, for each row."""

    def make(text: str) -> tuple:
        bpe = loaded(path)
        packed = bpe.packed(text)
        back = bpe.decode(np.frombuffer(packed, "<u4").tolist())
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    return _mapped(docs, columns, [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())], make)
