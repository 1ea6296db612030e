"""From queries to candidate catalog rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.index import top_k
from quillon.operators.sized import small


def exact_map(mappings: DataFrame, catalog: DataFrame, key: str = "norm", code: str = "code", order: str = "ix") -> DataFrame:
    """(key, code) of verified mappings to known codes; of a key's rows the last one counts."""
    known = mappings.join(catalog.select(code).distinct(), code, "left_semi")
    return known.groupBy(key).agg(F.max_by(code, order).alias(code))


def with_verified(queries: DataFrame, exact: DataFrame, key: str = "norm", code: str = "code") -> DataFrame:
    """Queries with ``verified_code``, or null."""
    return queries.join(exact.select(key, F.col(code).alias("verified_code")), key, "left")


def blocked(queries: DataFrame, catalog: DataFrame, block: str) -> DataFrame:
    """Pairs with an equal block; a query without a block meets the whole catalog.

    Two branches, as a join on "equal or null" would plan as a nested loop.  The branch
    of unblocked queries is a :func:`full_scan`.
    """
    cat = catalog.withColumnRenamed(block, f"catalog_{block}")
    equal = queries.filter(F.col(block).isNotNull()).join(cat, F.col(block) == F.col(f"catalog_{block}"))
    return equal.unionByName(full_scan(queries.filter(F.col(block).isNull()), cat))


def full_scan(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every query with every catalog row; the catalog, some thousand rows by nature, is broadcast if it is that small."""
    return queries.join(small(catalog))


def candidates(*pools: DataFrame, query: str = "qid", code: str = "code") -> DataFrame:
    """Distinct (query, code) of several pools, with the number of the first pool that has it."""
    marked = [p.select(query, code, F.lit(i).alias("pool")) for i, p in enumerate(pools)]
    return reduce(DataFrame.unionByName, marked).groupBy(query, code).agg(F.min("pool").alias("pool"))


def pool_of(sims: DataFrame, k: int, query: str = "qid", code: str = "code", sim: str = "sim") -> DataFrame:
    """The ``k`` nearest codes of each query; ties by code."""
    return top_k(sims, query, [F.desc(sim), F.asc(code)], k).select(query, code)


def first_known(queries: DataFrame, *sources: tuple[DataFrame, str], code: str = "code", name: str = "modality") -> DataFrame:
    """``name`` of each code from the first source that knows it."""
    out = queries
    for i, (source, column) in enumerate(sources):
        out = out.join(source.select(code, F.col(column).alias(f"__{i}")).dropDuplicates([code]), code, "left")
    found = [F.col(f"__{i}") for i in range(len(sources))]
    return out.withColumn(name, F.coalesce(*found)).drop(*[f"__{i}" for i in range(len(sources))])
