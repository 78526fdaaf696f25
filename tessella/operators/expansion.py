"""Query expansion as column functions over a column of queries.

The tables of terms are small and fixed, so they are array literals: a query is matched in its own row,
without a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.lexicon import DOMAIN_TERMS, GENERIC_TERMS, SYNONYMS

MODES = ("full", "synonyms", "technical", "hyde")


def _matched(query: Column, table: dict[str, list[str]], n: int) -> Column:
    """The first n terms of every phrase that the query holds, in the table's order."""
    low = F.lower(query)
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(F.contains(low, F.lit(phrase)), F.array(*map(F.lit, terms[:n]))).otherwise(none) for phrase, terms in table.items()])


def _distinct_by_case(terms: Column) -> Column:
    """Terms without those that an earlier one equals but for case."""
    lows = F.transform(terms, F.lower)
    return F.filter(terms, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1)


def synonyms(query: Column) -> Column:
    return F.slice(F.array_distinct(_matched(query, SYNONYMS, 2)), 1, 6)


def technical(query: Column) -> Column:
    return F.slice(F.array_distinct(_matched(query, DOMAIN_TERMS, 3)), 1, 6)


def full_terms(query: Column) -> Column:
    found = _distinct_by_case(F.concat(_matched(query, SYNONYMS, 3), _matched(query, DOMAIN_TERMS, 2)))
    return F.slice(F.when(F.size(found) == 0, F.array(*map(F.lit, GENERIC_TERMS))).otherwise(found), 1, 8)


def full(query: Column) -> Column:
    return F.concat(query, F.lit(" including "), F.array_join(full_terms(query), ", "))


#: What stands before and after the expanded query in a hypothetical passage.
PASSAGE = (
    "In modern distributed systems, ",
    ".\nThe system handles this through a combination of horizontal scaling,\nload balancing, and fault-tolerant design patterns.\n"
    "Autoscaling policies adjust the number of running instances based on\nobserved metrics such as CPU utilisation and request queue depth.\n"
    "This ensures consistent performance during traffic spikes and peak load\nconditions while maintaining low latency and high availability.",
)
#: Beginnings of variants, and what is left out of the query behind them.
VARIANTS = (("What mechanisms are used for ", ("how does", "how is")), ("What are the challenges and solutions for ", ("how",)))


def hyde(query: Column) -> Column:
    """A passage such as an answer might hold."""
    return F.concat(F.lit(PASSAGE[0]), full(query), F.lit(PASSAGE[1]))


def keywords_added(query: Column, expanded: Column) -> Column:
    """Words of four letters or more that the expansion adds, ten at most."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{4,}"), 0)
    return F.slice(F.array_except(words(expanded), words(query)), 1, 10)


def variants(query: Column, max_variants: int = 3) -> Column:
    """The query, one on mechanisms, one on challenges, and the full expansion; the first max_variants of them, each once."""

    bare = lambda parts: F.trim(reduce(lambda c, p: F.replace(c, F.lit(p), F.lit("")), parts, F.lower(query)))
    made = F.array(query, *[F.concat(F.lit(begin), bare(parts), F.lit("?")) for begin, parts in VARIANTS], full(query))
    return F.array_distinct(F.slice(made, 1, max_variants))


def expand(queries: DataFrame, mode: str = "full", max_variants: int = 3, query: str = "query") -> DataFrame:
    """queries with expanded_query, expansion_mode, keywords_added and variants. A query that matches no phrase of its mode's table is
    expanded in full; blank queries are errors of the caller and are dropped."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    q = F.col(query)
    rows = queries.where(F.trim(q) != "")
    if mode == "full":
        expanded, used = full(q), F.lit("full")
    elif mode == "hyde":
        expanded, used = hyde(q), F.lit("hyde")
    else:
        found = synonyms(q) if mode == "synonyms" else technical(q)
        joined = F.concat(q, F.lit(", " if mode == "synonyms" else " — related concepts: "), F.array_join(found, ", "))
        expanded, used = F.when(F.size(found) > 0, joined).otherwise(full(q)), F.when(F.size(found) > 0, F.lit(mode)).otherwise(F.lit("full"))
    out = rows.withColumns({"expanded_query": expanded, "expansion_mode": used})
    return out.withColumns({"keywords_added": keywords_added(q, F.col("expanded_query")), "variants": variants(q, max_variants)})
