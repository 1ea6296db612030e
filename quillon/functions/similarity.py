"""Scores of pairs of texts and attributes; built-in expressions but for the edit ratio."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.functions import rewrite
from quillon.rules import tables as T


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 for equal texts, less by insertions and deletions."""
    both = len(a) + len(b)
    return 100.0 if not both else 200.0 * lcs_length(a, b) / both


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common words and the common words with either side's own; 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, own_a, own_b = sorted(x & y), sorted(x - y), sorted(y - x)
    if common and (not own_a or not own_b):
        return 100.0
    joined = " ".join(common)
    with_a, with_b = " ".join([*common, *own_a]), " ".join([*common, *own_b])
    best = indel_ratio(with_a, with_b)
    return max(best, indel_ratio(joined, with_a), indel_ratio(joined, with_b)) if common else best


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel similarity of two columns, 0 to 100; null texts are empty."""
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    """Token-set similarity of two columns, 0 to 1; null texts are empty."""
    return pd.Series([token_set_ratio(x or "", y or "") / 100.0 for x, y in zip(a, b)])


def _share(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return _share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def weighted_overlap(a: Column, b: Column) -> Column:
    return _share(F.size(F.array_intersect(a, b)), F.size(a) + F.size(b))


def coverage(of: Column, by: Column) -> Column:
    """Share of the distinct entries of ``of`` that ``by`` has."""
    return _share(F.size(F.array_intersect(of, by)), F.size(F.array_distinct(of)))


def is_prefix(query: Column, description: Column) -> Column:
    return F.when(description.startswith(query), 1.0).otherwise(0.0)


def abbreviation_score(query: Column, description: Column, synonyms: Mapping[str, Sequence[str]] = T.SYNONYMS, expansions: Mapping[str, str] = T.EXPANSIONS) -> Column:
    """0.3 for each abbreviation whose meaning the description has (as substrings), 1 at most."""
    q, d = F.upper(query), F.upper(description)
    hits = [q.contains(a) & reduce(Column.__or__, [d.contains(s) for s in names]) for a, names in synonyms.items()]
    hits += [q.contains(a) & d.contains(e) for a, e in expansions.items()]
    return F.least(sum((h.cast("int") for h in hits), F.lit(0)) * 0.3, F.lit(1.0))


def procedure_score(keywords: Column, description: Column, alternatives: Mapping[str, str] = T.PROCEDURE_ALTERNATIVES) -> Column:
    """0 without keywords, -2 if none is met, else their share met, and 0.5 more if all are."""
    d = F.upper(description)

    def met(k: Column) -> Column:
        out = rewrite.has_phrase(d, k)
        for word, pattern in alternatives.items():
            out = out | ((k == word) & d.rlike(pattern))
        return out

    n, hits = F.size(keywords), F.size(F.filter(keywords, met))
    return F.when(n == 0, 0.0).when(hits == 0, -2.0).otherwise(hits / n + F.when(hits == n, 0.5).otherwise(0.0))


def generic_procedure_score(query_procedure: Column, description: Column) -> Column:
    own = F.coalesce(*[F.when(F.upper(description).rlike(p), F.lit(v)) for p, v in T.GENERIC_PROCEDURES])
    return F.when(query_procedure.isNull(), 0).when(own == query_procedure, 150).when(own.isNotNull(), -100).otherwise(-50)


def modifier_penalty(query: Column, description: Column, modifiers: Mapping[str, int] = T.MODIFIERS) -> Column:
    q, d = F.upper(query), F.upper(description)
    return -sum((F.when(d.contains(m) & ~q.contains(m), v).otherwise(0) for m, v in modifiers.items()), F.lit(0))


def view_score(asked: Column, has: Column, is_least: Column) -> Column:
    off = F.abs(asked - has)
    return (
        F.when(asked.isNull(), 0).when(asked == has, 100).when(is_least & (asked > has), 90).when(off == 1, -50).when(off == 2, -100).otherwise(-150)
    )


def view_match(asked: Column, has: Column, is_least: Column) -> Column:
    return F.when(asked.isNull(), 0.0).when((asked == has) | (is_least & (asked > has)), 1.0).otherwise(-1.0)


def contrast_match(asked: Column, has: Column) -> Column:
    return F.when(asked == "UNKNOWN", 0.0).when(asked == has, 1.0).otherwise(-1.0)


def laterality_match(asked: Column, has: Column) -> Column:
    return F.when(asked == "NONE", 0.0).when(asked == has, 1.0).when(has == "NONE", 0.5).otherwise(-1.0)


def log_popularity(n: Column) -> Column:
    return F.log1p(F.coalesce(n, F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(a: Column) -> Column:
    """A vector over its length; a zero vector stays as it is."""
    over = lambda v, n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))
    return let(a, lambda v: let(F.sqrt(dot(v, v)), lambda n: over(v, n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is missing or zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def confidence_band(score: Column, high: float = T.HIGH, medium: float = T.MEDIUM) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def display_score(raw: Column) -> Column:
    """A ranker's raw score on the scale of points; halves go to the even number."""
    return F.bround(raw * 50 + 250, 0).cast("int")
