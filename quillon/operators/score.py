"""The additive rule model: points by term, and their log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import rewrite, similarity
from quillon.rules import tables as T


def _body(q: Column, regions: Column, description: Column) -> Column:
    parts = q["body_parts"]
    named = F.exists(parts, lambda p: description.contains(p))
    n = F.size(F.array_intersect(parts, regions))
    with_regions = F.when(n > 0, n * 50).when(named, 50).otherwise(-200)
    return F.when(F.size(parts) == 0, 0).otherwise(F.when(F.size(regions) > 0, with_regions).otherwise(F.when(named, 0).otherwise(-300)))


def terms(q: Column, norm: Column, char_sim: Column, fuzzy: Column) -> dict[str, Column]:
    """Points by term of a query (struct ``q``, text ``norm``) against the catalog columns
    ``modality``, ``views``, ``least_views``, ``contrast``, ``laterality``, ``regions``, ``desc`` and ``tokens``."""
    c = F.col
    desc = c("desc")
    contrast = F.when(q["contrast"] == "UNKNOWN", 0).when(q["contrast"] == c("contrast"), 80).otherwise(-120)
    side = F.when(q["laterality"] == "NONE", 0).when(q["laterality"] == c("laterality"), 60).when(c("laterality") == "NONE", 20).otherwise(-150)
    kw = similarity.procedure_score(q["procedure_keywords"], desc)
    plural = F.when(~q["has_plurality"], 0).when(rewrite.has_phrase(desc, "TWIN") | desc.rlike("|".join(T.PLURALITY)), 20).otherwise(-60)
    return {
        "modality": F.lit(100),
        "views": similarity.view_score(q["views"], c("views"), c("least_views")),
        "contrast": contrast,
        "laterality": side,
        "body": _body(q, c("regions"), desc),
        "procedure": F.when(kw < 0, -150).otherwise((kw * 40).cast("int")),
        "generic": similarity.generic_procedure_score(q["generic_procedure"], desc),
        "abbreviation": similarity.abbreviation_score(norm, desc) * 40,
        "plurality": plural,
        "modifiers": similarity.modifier_penalty(norm, desc),
        "knowledge": (similarity.coverage(c("tokens"), q["knowledge_tokens"]) * 30).cast("int"),
        "char_tfidf": (char_sim * 50).cast("int"),
        "fuzzy": (fuzzy * 30).cast("int"),
    }


def rule_score(points: Mapping[str, Column], blocked: Column | None = None) -> Column:
    """Sum of the points, not below 0; 0 where ``blocked`` (another modality)."""
    total = F.greatest(reduce(Column.__add__, [p.cast("double") for p in points.values()]), F.lit(0.0))
    return total if blocked is None else F.when(blocked, 0.0).otherwise(total)


def score_log(points: Mapping[str, Column], total: Column) -> Column:
    """Array of (component, value, detail) of the terms that gave or took points, the total last."""
    rows = [F.when(p != 0, F.struct(F.lit(n).alias("component"), p.cast("int").alias("value"), F.lit("").alias("detail"))) for n, p in points.items()]
    end = F.struct(F.lit("TOTAL").alias("component"), total.cast("int").alias("value"), F.lit("").alias("detail"))
    return F.array_compact(F.array(*rows, end))


def boosts(scored: DataFrame, table: Sequence[tuple[str, str, int]], code: str = "code", score: str = "score") -> DataFrame:
    """Add conditional points: rows (code, condition as SQL, points)."""
    extra = [F.when((F.col(code) == who) & F.expr(when), points).otherwise(0) for who, when, points in table]
    return scored.withColumn(score, F.col(score) + sum(extra, F.lit(0))) if extra else scored


def _points(q: str, norm: str) -> dict[str, Column]:
    return terms(F.col(q), F.col(norm), F.coalesce(F.col("char_sim"), F.lit(0.0)), F.col("fuzzy"))


def other_modality(q: Column) -> Column:
    """Pairs that score 0 whatever their points."""
    return q["modality"].isNotNull() & (q["modality"] != F.col("modality"))


def score_pairs(pairs: DataFrame, q: str = "q", norm: str = "normalized") -> DataFrame:
    """Add ``score``, and ``fuzzy``, its one term that runs in Python and so is worked out once as a column."""
    work = pairs.withColumn("fuzzy", similarity.fuzzy(F.col(norm), F.col("desc")))
    return work.withColumn("score", rule_score(_points(q, norm), other_modality(F.col(q))))


def with_log(rows: DataFrame, q: str = "q", norm: str = "normalized", score: str = "score") -> DataFrame:
    """Add ``score_log`` to rows of :func:`score_pairs`; meant for those that ranking has kept."""
    return rows.withColumn("score_log", score_log(_points(q, norm), F.col(score)))


def placeholder_log(total: Column, prior: int = T.PRIOR_POINTS) -> Column:
    """The log of a verified row that no ranking had: a prior and the total."""
    row = lambda n, v: F.struct(F.lit(n).alias("component"), v.cast("int").alias("value"), F.lit("").alias("detail"))
    return F.array(row("ranker", total - prior), row("prior", F.lit(prior)), row("TOTAL", total))


def _names_part(q: Column) -> Column:
    return F.exists(q["body_parts"], lambda p: F.col("desc").contains(p))


def _no_overlap(q: Column) -> Column:
    return (F.size(q["body_parts"]) > 0) & ~F.arrays_overlap(q["body_parts"], F.col("regions"))


def forest_points(proba: Column, q: Column, norm: Column) -> Column:
    """The older model's points: 500 times the probability, and what differs or is met."""
    c = F.col
    other = terms(q, norm, F.lit(0.0), F.lit(0.0))
    views = F.least(other["views"], F.lit(0))
    contrast = F.when(similarity.contrast_match(q["contrast"], c("contrast")) < 0, -120).otherwise(0)
    side = F.when(similarity.laterality_match(q["laterality"], c("laterality")) < 0, -60).otherwise(0)
    body = F.when(~_no_overlap(q), 0).when(_names_part(q), 50).otherwise(-400)
    return (proba * 500).cast("int") + views + contrast + side + body + other["procedure"] + other["generic"] + other["plurality"] + other["modifiers"]


def forest_or_rules(proba: Column, rules: Column, q: Column, norm: Column) -> Column:
    """The better of both models; the rules are not asked where the body parts differ."""
    forest, differs = forest_points(proba, q, norm).cast("double"), _no_overlap(q) & ~_names_part(q)
    return F.when(~differs & (rules > forest), rules).otherwise(forest)
