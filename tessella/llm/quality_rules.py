"""Quality rules, line first.

Every line of a text is held against rules for punctuation, navigation, shouting, repetition and
boilerplate; lines that fail are removed, and a document that loses too much of its text is rejected.

Defined cases: a null text counts as empty and has no words, so it fails the base rule; lines without
a word are kept and weigh nothing; a very long text or line is judged whole; an empty table gives an
empty result; equal rows get equal results; a column of the input named like one
of the results is replaced."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.texts import per_row, unpacked, whole

#: Symbols that count as marks of markup or navigation.
SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line as boilerplate, in lower case; none holds another.
BOILERPLATE = (
    "licensed under", "all rights reserved", "general public license", "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service", "lorem ipsum",
    "enable javascript", "subscribe to our newsletter", "click here", "sign in to",
    "alle rechte vorbehalten", "cookies akzeptieren", "allgemeine geschäftsbedingungen", "newsletter abonnieren", "hier klicken",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "conditions d'utilisation", "cliquez ici",
    "todos los derechos reservados", "aceptar cookies", "política de privacidad", "términos de uso", "haga clic aquí",
)
#: Marks that end a sentence or a part of one.
STOPS = (b".", b"!", b"?", b",", b";", b":")


@dataclass(frozen=True)
class QualityRules:
    """A line fails if one of these holds.

    navigation: symbols above symbol_percent of its words; or a menu: menu_words words or more, each with a capital first letter, none with a stop.
    boilerplate: boilerplate phrases hold at least boilerplate_percent of its words.
    punctuation: words without a letter or digit, or words that end in a doubled mark (!! or ??), above marks_percent of its words.
    shouting: shout_words words or more, with only capitals above shout_percent of them.
    repetition: repeat_line_words words or more, of which fewer than distinct_percent are distinct.
    repeated: it equals an earlier line of the text (both with repeated_line_words words at least).

    A document is rejected when the lines that fail hold more than lost_percent of its words, or when no word is left."""

    symbol_percent: int = 10
    shout_words: int = 3
    shout_percent: int = 60
    marks_percent: int = 30
    repeat_line_words: int = 12
    distinct_percent: int = 30
    repeated_line_words: int = 3
    lost_percent: int = 40
    base_least_words: int = 10
    base_repeat_percent: int = 20
    boilerplate_percent: int = 10
    menu_words: int = 5


_phrase_words = {p: p.count(" ") + 1 for p in BOILERPLATE}
_loose_mark = re.compile(r"(?:^|[ \t-\r])[^a-zA-Z0-9 \t-\r]+(?:[ \t-\r]|$)").search
_alnum = re.compile(r"[^\W_]")
_repeat_window = 5


def _symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def repeated_words(words: list) -> int:
    """Words that lie in a window of five found twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + _repeat_window - max(i, end)
            end = i + _repeat_window
    return total


def _is_boilerplate(line: str, n: int, percent: int) -> bool:
    low = line.lower()
    found = sum(k * low.count(p) for p, k in _phrase_words.items() if p in low)
    return found > 0 and 100 * found >= percent * n


def _capital(word: bytes) -> bool:
    return 65 <= word[0] <= 90 or (word[0] >= 0xC3 and unicodedata.category(word.decode()[0]) == "Lu")


def _is_menu(words: list[bytes]) -> bool:
    return all(map(_capital, words)) and not any(w.endswith(STOPS) for w in words)


def line_verdict(line: str, words: list[bytes], seen: set[str], rules: QualityRules, marks: int = -1, boiler: bool = True, capitals: int = -1) -> str:
    """'' if the line may stay, else the name of the rule that it fails.

    marks, boiler, capitals: symbols, whether there is boilerplate, and words in capitals in the whole
    text, where known; rules that cannot fail then need not look."""
    n = len(words)
    if not n:
        return ""
    repeated = line in seen
    seen.add(line)
    if repeated and n >= rules.repeated_line_words:
        return "repeated"
    if marks and 100 * _symbols(line) > rules.symbol_percent * n:
        return "navigation"
    if n >= rules.menu_words and _is_menu(words):
        return "navigation"
    if boiler and _is_boilerplate(line, n, rules.boilerplate_percent):
        return "boilerplate"
    if _loose_mark(line) and 100 * sum(not _alnum.search(w.decode()) for w in words) > rules.marks_percent * n:
        return "punctuation"
    if "!!" in line or "??" in line:
        marked = sum(w.endswith((b"!!", b"??")) for w in words)
        if 100 * marked > rules.marks_percent * n:
            return "punctuation"
    if n >= rules.shout_words and capitals:
        shouted = sum(map(str.isupper, (w.decode() for w in words if len(w) > 1)))
        if 100 * shouted > rules.shout_percent * n:
            return "shouting"
    if n >= rules.repeat_line_words and 100 * len(set(words)) < rules.distinct_percent * n:
        return "repetition"
    return ""


def judge(text: str | None, rules: QualityRules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words, clean text, rules that failed a line."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = text.split("\n")
    filled = with_words = lost = 0
    seen: set[str] = set()
    marks, boilerplate, capitals = _symbols(text), any(map(text.lower().__contains__, BOILERPLATE)), sum(map(str.isupper, text.split()))
    if capitals < rules.shout_words:
        capitals = 0
    kept_lines, failed = [], Counter()
    for line in lines:
        own = line.encode().split()
        verdict = line_verdict(line, own, seen, rules, marks, boilerplate, capitals)
        with_words += bool(own)
        if verdict:
            failed[verdict] += 1
            lost += len(own)
        else:
            kept_lines.append(line)
            filled += len(own)
    duplicates = with_words - len(seen)
    repeats = repeated_words(words)
    base_failed = n < rules.base_least_words or 100 * repeats > rules.base_repeat_percent * n
    kept = not base_failed and filled > 0 and 100 * lost <= rules.lost_percent * n
    return n, chars, marks, duplicates, repeats, base_failed, kept, lost, "\n".join(kept_lines), sorted(failed)


RESULT = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(k, T.BooleanType()) for k in ("base_failed", "kept")]
    + [T.StructField("n_lost_words", T.LongType()), T.StructField("clean_text", T.StringType()), T.StructField("failed_rules", T.ArrayType(T.StringType()))]
)


def quality(docs: DataFrame, columns: list[str] | None = None, rules: QualityRules = QualityRules(), clean: bool = True) -> DataFrame:
    """Columns of docs (default: all) and RESULT for each row. Without clean, clean_text is null.

    One pass, no shuffle: a row's result depends on its own text alone."""
    def maker():
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.string(), pa.list_(pa.string())]

        def make(texts: pa.Array) -> list[pa.Array]:
            made = list(zip(*(judge(text, rules) for text in texts.to_pylist()), strict=True))
            if not clean:
                made[8] = [None] * len(texts)
            return [pa.array(x, t) for x, t in zip(made, types, strict=True)]

        return make

    return per_row(docs, docs.columns if columns is None else columns, "text", RESULT.fields, maker)


def accepted(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; text loses the lines that failed."""
    return unpacked(quality(whole(docs, "text"), ["whole"], rules).where("kept"), docs.columns, text="clean_text")
