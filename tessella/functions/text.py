"""Normalisation and cleaning of texts as column functions.

Steps that are one replacement are built-in functions. Steps that look at lines, NFKC, and the whole of
preprocess() run as one pass over Arrow batches: nested lambdas over arrays of lines leave generated code
and cost several times as much. A null text stays null."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The white space of str.strip() and str.split().
WHITE = "".join(filter(str.isspace, map(chr, range(0x3001))))

#: What the steps replace, and by what ($1: the first group).
CODE_FENCE = (r"```[`\s]*([\s\S]*?)[`\s]*```", "$1")
INLINE_CODE = (r"`([^`]+)`", "$1")
EMPHASIS = (r"\*{1,3}([^\n]+?)\*{1,3}", "$1")
LINK = (r"\[([^\n]+?)\]\([^\n]+?\)", "$1")
HEADER_MARK = (r"(?m)^#{1,6}\s+", "")
DASHES = (r"-{4,}", "")
DOUBLE_DASHES = (r"={4,}", "")
REPEATED_MARK = (r"([!?.,:;])\1{2,}", "$1")
SPACES = (r"[ \t]+", " ")
BLANK_LINES = (r"\n{3,}", "\n\n")
NO_WORD = r"[^a-zA-Z0-9 ]+"


@dataclass(frozen=True)
class CleanOptions:
    normalise_unicode: bool = True
    strip_markdown: bool = True
    remove_boilerplate: bool = True
    min_line_length: int = 10
    remove_duplicate_lines: bool = True
    lowercase: bool = True
    remove_repeated_punctuation: bool = True
    collapse_whitespace: bool = True


#: Texts of about so many bytes are Python strings at once.
PIECE_BYTES = 1 << 20


def pieces(texts: pa.Array, most_bytes: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """The same texts in slices of about most_bytes; a longer text comes alone."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // most_bytes)) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))


def _mapped(change: Callable[[str], str]) -> Callable[[Column], Column]:
    """change() as a function of a column, over Arrow batches, of which a piece at a time is Python strings."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([None if t is None else change(t) for t in part.to_pylist()], pa.string()) for part in pieces(texts)])

    return run


def _replacement(rule: tuple[str, str], only_if: str) -> Callable[[str], str]:
    """A rule for single texts; texts without only_if are left alone at once."""
    replace, to = re.compile(rule[0]).sub, rule[1].replace("$1", r"\1")
    return lambda t: replace(to, t) if only_if in t else t


_plain_markdown = [_replacement(rule, needs) for rule, needs in ((CODE_FENCE, "```"), (INLINE_CODE, "`"), (EMPHASIS, "*"), (LINK, "]("), (HEADER_MARK, "#"), (DASHES, "----"), (DOUBLE_DASHES, "===="))]
_squeeze_marks, _squeeze_blanks = re.compile(REPEATED_MARK[0]).sub, re.compile(r" [ \t]+|\t[ \t]*").sub
_fewer_blank_lines, _no_word = _replacement(BLANK_LINES, "\n\n\n"), re.compile(NO_WORD).fullmatch


def _long_lines(text: str, least: int) -> list[str]:
    bare = ((line, line.strip()) for line in text.splitlines())
    return [line if b else "" for line, b in bare if not b or (len(b) >= least and not _no_word(b))]


def _changing_lines(lines: list[str]) -> list[str]:
    keys = [line.strip().lower() for line in lines]
    return [line for line, key, before in zip(lines, keys, [None, *keys], strict=False) if key != before]


def nfkc(text: Column) -> Column:
    """NFKC form. Texts of ASCII alone never reach Python."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def _nfkc_lines(text: bytes) -> bytes:
    """The NFKC form of a text in UTF-8. A line feed neither joins nor reorders with what stands beside it, so that lines are taken alone: a
    long text is never one wide string."""
    return b"\n".join([line if line.isascii() else unicodedata.normalize("NFKC", line.decode()).encode() for line in text.split(b"\n")])


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    made = [pa.array([None if t is None else _nfkc_lines(t) for t in part.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string()) for part in pieces(texts)]
    return pa.concat_arrays(made)


def _by(text: Column, rule: tuple[str, str]) -> Column:
    return F.regexp_replace(text, *rule)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def collapse_blank_lines(text: Column) -> Column:
    return _by(text, BLANK_LINES)


def expand_tabs(text: Column) -> Column:
    return F.replace(text, F.lit("\t"), F.lit("    "))


def strip_code_fences(text: Column) -> Column:
    return _by(text, CODE_FENCE)


def strip_inline_code(text: Column) -> Column:
    return _by(text, INLINE_CODE)


def strip_emphasis(text: Column) -> Column:
    return _by(text, EMPHASIS)


def strip_links(text: Column) -> Column:
    return _by(text, LINK)


def strip_headers(text: Column) -> Column:
    return _by(text, HEADER_MARK)


def strip_rules(text: Column) -> Column:
    return _by(_by(text, DASHES), DOUBLE_DASHES)


def strip_markdown(text: Column) -> Column:
    for step in (strip_code_fences, strip_inline_code, strip_emphasis, strip_links, strip_headers, strip_rules):
        text = step(text)
    return text


def drop_boilerplate_lines(text: Column, min_length: int = 10) -> Column:
    """Keeps blank lines (as empty ones) and lines of min_length characters, not those without ASCII letter, digit or space."""
    return _mapped(lambda t: "\n".join(_long_lines(t, min_length)))(text)


def drop_repeated_lines(text: Column) -> Column:
    """Drops a line that equals the one before it, but for case and outer white space."""
    return _mapped(lambda t: "\n".join(_changing_lines(t.splitlines())))(text)


def squeeze_punctuation(text: Column) -> Column:
    return _by(text, REPEATED_MARK)


def squeeze_spaces(text: Column) -> Column:
    return collapse_blank_lines(_by(text, SPACES))


def loader_normalise(text: Column) -> Column:
    """What a reader does to a document before anything else."""
    return strip(expand_tabs(collapse_blank_lines(nfkc(text))))


def cleaner(options: CleanOptions = CleanOptions()) -> Callable[[str], str]:
    """The cleaning of one text: the chosen steps, always in the same order."""
    steps: list[Callable[[str], str]] = []
    if options.normalise_unicode:
        steps.append(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t))
    if options.strip_markdown:
        steps += _plain_markdown
    if options.remove_boilerplate or options.remove_duplicate_lines:

        def by_line(t: str) -> str:
            lines = _long_lines(t, options.min_line_length) if options.remove_boilerplate else t.splitlines()
            return "\n".join(_changing_lines(lines) if options.remove_duplicate_lines else lines)

        steps.append(by_line)
    if options.lowercase:
        steps.append(str.lower)
    if options.remove_repeated_punctuation:
        steps.append(lambda t: _squeeze_marks(r"\1", t))
    if options.collapse_whitespace:
        steps += [lambda t: _squeeze_blanks(" ", t), _fewer_blank_lines]

    def clean(text: str) -> str:
        for step in steps:
            text = step(text)
        return text.strip()

    return clean


def preprocess(text: Column, options: CleanOptions = CleanOptions()) -> Column:
    """Cleans a text in a fixed order; a blank one becomes ''. One pass over Arrow batches: NFKC needs Python in any case."""
    return _mapped(cleaner(options))(text)


def dedup_key(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def exact_dedup(docs, order: str = "doc_id", text: str = "text"):
    """The first row by order of each group of texts that are equal but for case and white space.

    Rows are compared by a digest of the key, so that only it is shuffled and sorted beside the row."""
    keyed = docs.withColumn("__key", F.sha2(dedup_key(F.col(text)), 256))
    return keyed.withColumn("__n", F.row_number().over(W.partitionBy("__key").orderBy(order))).where("__n = 1").drop("__key", "__n")
