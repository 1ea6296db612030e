"""From normalised text to typed attributes; all are column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillon.functions import rewrite, similarity
from quillon.rules import tables as T

#: Shortest word that is compared by edits, and the least ratio.
FUZZY_LENGTH, FUZZY_LEAST = 5, 85.0


def first_match(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """The value of the first pattern that occurs, or null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(v)) for p, v in patterns])


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def _has_any(tokens: Column, words: Sequence[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def views(norm: Column) -> Column:
    """Number of views: stated as VIEW, then as V, else two for a frontal and a lateral one."""
    t = rewrite.tokens(norm)
    stated = [F.nullif(F.regexp_extract(norm, p, 1), F.lit("")).try_cast("int") for p in (r"\b(\d+)\s*VIEW\b", r"\b(\d+)\s*V\b")]
    pair = _has_any(t, ("PA", "AP")) & _has_any(t, ("LAT", "LATERAL"))
    return F.coalesce(*stated, F.when(pair, F.lit(2)))


def modality(norm: Column, patterns=T.MODALITIES) -> Column:
    """Named modality, else radiography by its views or words, else what the anatomy implies."""
    t = rewrite.tokens(norm)
    xr = F.when(views(norm).isNotNull() | _has_any(t, T.XR_TOKENS), "XR")
    implied = [F.when(_has_any(t, words), m) for words, m in T.IMPLIED[:-1]]
    words, m = T.IMPLIED[-1]
    return F.coalesce(first_match(norm, patterns), xr, *implied, F.when(_has_any(t, words) & ~F.array_contains(t, "NM"), m))


def is_angiogram(norm: Column) -> Column:
    return norm.rlike(r"\bCT\b.*\bANGIOGRAM\b|\bANGIOGRAM\b.*\bCT\b")


def contrast(contrast_text: Column, norm: Column | None = None) -> Column:
    """WWOC, WOC, WC or UNKNOWN, of text in which contrast wordings are spelled out."""
    c = contrast_text
    out = (
        F.when(c.contains("WITH AND WITHOUT"), "WWOC")
        .when(c.rlike(r"\bWITHOUT\b"), "WOC")
        .when(~c.contains("CONTRAST"), "UNKNOWN")
        .when(c.rlike(r"\bWITH\b"), "WC")
        .otherwise("UNKNOWN")
    )
    return out if norm is None else F.when((out == "UNKNOWN") & is_angiogram(norm), "WC").otherwise(out)


def laterality(norm: Column) -> Column:
    left, right = norm.rlike(r"\bLEFT\b"), norm.rlike(r"\bRIGHT\b")
    return (
        F.when(norm.rlike(r"\bUNILATERAL\b"), "NONE")
        .when(norm.rlike(r"\bBILATERAL\b") | (left & right), "BI-LATERAL")
        .when(left, "LEFT")
        .when(right, "RIGHT")
        .otherwise("NONE")
    )


def body_vocabulary(catalog_regions: DataFrame, region: str = "region", fallback: Sequence[str] = T.BODY_PARTS) -> DataFrame:
    """Distinct normalised body parts of the catalog (an array column) and the known ones."""
    spark = catalog_regions.sparkSession
    known = spark.range(1).select(F.explode(F.array(*map(F.lit, fallback))).alias("part"))
    parts = catalog_regions.select(F.explode(region).alias("part")).unionByName(known)
    return parts.select(rewrite.cleanup(F.upper("part")).alias("part")).filter("part <> ''").distinct()


def body_parts(norm: Column, vocabulary: Column, aliases: Mapping[str, str] = T.BODY_ALIASES, drop: Sequence[str] = T.NOT_BODY, most: int = 3) -> Column:
    """Parts of ``vocabulary`` (a sorted array) named in the text, then those that aliases name; the first ``most``, less ``drop``."""
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(c).alias("c")) for a, c in aliases.items()]).cast("array<struct<a:string,c:string>>")
    named = F.filter(vocabulary, lambda v: (v != "") & (v != "UNKNOWN") & rewrite.has_phrase(norm, v))
    also = F.transform(F.filter(table, lambda x: rewrite.has_phrase(norm, x["a"])), lambda x: x["c"])
    return F.array_except(F.slice(F.array_distinct(F.concat(named, also)), 1, most), F.array(*map(F.lit, drop)))


@F.pandas_udf(ArrayType(StringType()))
def fuzzy_parts(norm: pd.Series, vocabulary: pd.Series) -> pd.Series:
    """For texts that name no part: the part whose word is most like each long alphabetic word, if like enough.

    Null texts give null, so that callers can leave out rows that need no guess.
    """
    seen: dict[tuple[str, int], str | None] = {}

    def guess(token: str, parts) -> str | None:
        best, part = FUZZY_LEAST, None
        for p in parts:
            for w in p.split() if p != "UNKNOWN" else ():
                if len(w) >= FUZZY_LENGTH and (r := similarity.indel_ratio(token, w)) >= best and (part is None or r > best):
                    best, part = r, p
        return part

    def one(text, parts):
        if text is None:
            return None
        out = []
        for token in text.split():
            if len(token) >= FUZZY_LENGTH and token.isalpha():
                if (token, len(parts)) not in seen:
                    seen[token, len(parts)] = guess(token, parts)
                found = seen[token, len(parts)]
                if found and found not in out:
                    out.append(found)
        return out[:3]

    return pd.Series([one(t, v) for t, v in zip(norm, vocabulary)])


def expand_hints(norm: Column, hints=T.HINTS) -> Column:
    """Words of the text and those that the anatomy hints add."""
    extra = [F.when(norm.rlike(p), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for p, words in hints]
    return F.array_distinct(F.concat(rewrite.tokens(norm), *extra))


def procedures(norm: Column, keywords: Sequence[str] = T.PROCEDURES) -> Column:
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: rewrite.has_phrase(norm, k))


def generic_procedure(norm: Column) -> Column:
    return first_match(norm, T.GENERIC_PROCEDURES)


def plural(norm: Column) -> Column:
    return any_match(norm, T.PLURALITY)


def flags(raw: Column, norm: Column) -> dict[str, Column]:
    """Late trimester, transvaginal and twins, in the raw or the normalised text."""
    raw = F.upper(F.coalesce(raw, F.lit("")))
    return {
        "is_late_trimester": any_match(raw, T.LATE_TRIMESTER) | any_match(norm, T.LATE_TRIMESTER),
        "has_transvaginal": raw.rlike(T.TRANSVAGINAL) | norm.rlike(T.TRANSVAGINAL),
        "has_twins": raw.rlike(T.TWINS) | norm.rlike(T.TWINS),
    }


def states_least_views(description: Column) -> Column:
    return description.rlike(T.LEAST_VIEWS)


def catalog_modality(raw: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    merged = F.coalesce(*[F.when(up == k, v) for k, v in T.MODALITY_MERGES.items()])
    return F.coalesce(merged, F.nullif(up, F.lit("")), F.lit("UNKNOWN"))


def catalog_laterality(raw: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(up.isin("LEFT", "L", "LT"), "LEFT").when(up.isin("RIGHT", "R", "RT"), "RIGHT").when(up.startswith("BI"), "BI-LATERAL").otherwise("NONE")


def catalog_contrast(raw: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(up.isin("WC", "WOC", "WWOC"), up).otherwise("UNKNOWN")


def catalog_views(raw: Column) -> Column:
    text = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).otherwise(F.lit(1))


def catalog_regions(raw: Column) -> Column:
    parts = F.transform(F.split(F.upper(F.coalesce(raw, F.lit(""))), "[,/]"), rewrite.cleanup)
    return F.array_distinct(F.filter(parts, lambda p: ~p.isin("", "UNKNOWN", "NONE")))


def parse(queries: DataFrame, vocabulary: DataFrame, text: str = "query", user_rules: Sequence[rewrite.Rule] = ()) -> DataFrame:
    """Add ``normalized`` and the struct ``q`` of all attributes.

    ``vocabulary`` (column ``part``) is a catalog's body parts: it is gathered into one
    sorted array, which joins every query, so it must be the small table that it is.
    """
    vocab = vocabulary.agg(F.array_sort(F.collect_set("part")).alias("__vocab"))
    base = queries.withColumn("normalized", rewrite.normalize(F.col(text), user_rules)).withColumn("__contrast", rewrite.contrast_text(F.col(text)))
    norm = F.col("normalized")
    q = F.struct(
        modality(norm).alias("modality"),
        views(norm).alias("views"),
        contrast(F.col("__contrast"), norm).alias("contrast"),
        laterality(norm).alias("laterality"),
        F.coalesce(F.col("__guess"), F.col("__parts")).alias("body_parts"),
        expand_hints(norm).alias("knowledge_tokens"),
        procedures(norm).alias("procedure_keywords"),
        plural(norm).alias("has_plurality"),
        generic_procedure(norm).alias("generic_procedure"),
        *[c.alias(n) for n, c in flags(F.col(text), norm).items()],
    )
    named = base.join(F.broadcast(vocab)).withColumn("__parts", body_parts(norm, F.col("__vocab")))
    named = named.withColumn("__guess", fuzzy_parts(F.when(F.size("__parts") == 0, norm), F.col("__vocab")))
    return named.withColumn("q", q).drop("__vocab", "__contrast", "__parts", "__guess")
