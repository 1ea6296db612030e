"""Phrasing variants of catalog descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.rewrite import java_replacement
from quillon.operators.index import top_k
from quillon.rules import tables as T


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, Sequence[str]]] = T.SUBSTITUTIONS) -> DataFrame:
    """(ord, pattern, choice, replacement): a bounded table, one row for each replacement."""
    rows = [(i, f"(?i){p}", j, java_replacement(r)) for i, (p, rs) in enumerate(rules) for j, r in enumerate(rs)]
    cells = ", ".join("({}, {}, {}, {})".format(*(x if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in row)) for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {cells} AS r(ord, pattern, choice, replacement)")


def variants(catalog: DataFrame, rules: DataFrame, depth: int = 2, code: str = "code", description: str = "description") -> DataFrame:
    """Distinct (code, variant): every rule that matches, and pairs of rules in order that both match the original."""
    base = catalog.select(F.col(code), F.col(description).alias("__desc"))
    once = base.join(F.broadcast(rules)).filter(F.regexp_like("__desc", F.col("pattern")))
    change = lambda text: F.regexp_replace(text, F.col("pattern"), F.col("replacement"))
    out = once.select(code, "__desc", change(F.col("__desc")).alias("variant"))
    if depth > 1:
        later = rules.select(F.col("ord").alias("o2"), F.col("pattern").alias("p2"), F.col("replacement").alias("r2"))
        both = once.join(F.broadcast(later), F.col("ord") < F.col("o2")).filter(F.regexp_like("__desc", F.col("p2")))
        twice = F.regexp_replace(change(F.col("__desc")), F.col("p2"), F.col("r2"))
        out = out.unionByName(both.select(code, "__desc", twice.alias("variant")))
    tidy = out.withColumn("variant", F.trim(F.regexp_replace("variant", r"\s+", " ")))
    return tidy.filter(F.lower("variant") != F.lower("__desc")).select(code, "variant").distinct()


def training_pairs(catalog: DataFrame, rules: DataFrame, most: int = T.VARIANTS, depth: int = 2, code: str = "code", description: str = "description") -> DataFrame:
    """The description itself and the first ``most`` variants of each code, each once whatever its case."""
    some = top_k(variants(catalog, rules, depth, code, description), code, [F.asc("variant")], most).select(code, "variant")
    own = catalog.select(code, F.col(description).alias("variant"))
    both = own.unionByName(some).withColumn("__key", F.lower(F.trim("variant")))
    return both.groupBy(code, "__key").agg(F.min("variant").alias("variant")).select(code, "variant")
