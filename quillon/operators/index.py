"""Sparse and dense indexes in long form: one row for each document and term."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import similarity
from quillon.operators.sized import small

#: Terms of an index at most.
VOCABULARY = 5000


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """All character n-grams of the lower-cased text, repeats included."""
    t = F.lower(text)

    def of(n: int) -> Column:
        return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>")
        )

    return F.concat(*[of(n) for n in range(low, high + 1)])


def word_grams(text: Column) -> Column:
    """Words of two characters or more, and pairs of neighbours, of the lower-cased text."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"\b\w\w+\b"), F.lit(0))
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i))))
    return F.concat(w, F.coalesce(pairs, F.array().cast("array<string>")))


def term_counts(docs: DataFrame, id: str, grams: Column) -> DataFrame:
    """(id, term, tf)."""
    return docs.select(id, F.explode(grams).alias("term")).groupBy(id, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, most: int = VOCABULARY) -> DataFrame:
    """(term, df, idf) of the ``most`` frequent terms; ties by term.  idf = ln((1 + n) / (1 + df)) + 1."""
    totals = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    top = totals.orderBy(F.desc("total"), "term").limit(most)
    return top.select("term", "df", (F.log((n_docs + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weights(counts: DataFrame, vocab: DataFrame, id: str) -> DataFrame:
    """(id, term, w): tf-idf over terms of the vocabulary, rows of length one.

    The vocabulary has ``VOCABULARY`` rows at most, so it is broadcast.
    """
    raw = counts.join(F.broadcast(vocab), "term").select(id, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = raw.groupBy(id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, id).select(id, "term", (F.col("w") / F.col("norm")).alias("w"))


def sparse_cosine(a: DataFrame, b: DataFrame, a_id: str, b_id: str, name: str = "sim") -> DataFrame:
    """Cosines of all pairs that share a term, by an equi-join on the term (an inverted index)."""
    met = a.withColumnRenamed("w", "wa").join(b.withColumnRenamed("w", "wb"), "term")
    return met.groupBy(a_id, b_id).agg(F.sum(F.col("wa") * F.col("wb")).alias(name))


def top_k(pairs: DataFrame, query: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each query; Spark limits groups before it shuffles them."""
    return pairs.withColumn(rank, F.row_number().over(W.partitionBy(query).orderBy(*order))).filter(F.col(rank) <= k)


def dense_pairs(queries: DataFrame, index: DataFrame, query_vec: str, index_vec: str, name: str = "sim") -> DataFrame:
    """Cosines of a stated, small set of queries with all rows of the index.

    The queries are the broadcast side as long as they are few; more of them meet the
    index in blocks.
    """
    q = queries.withColumn("__q", similarity.unit(F.col(query_vec))).drop(query_vec)
    i = index.withColumn("__i", similarity.unit(F.col(index_vec))).drop(index_vec)
    return i.join(small(q)).withColumn(name, similarity.dot(F.col("__q"), F.col("__i"))).drop("__q", "__i")


def hashed_encoder(dim: int = 64) -> Callable[[Column], Column]:
    """A text encoder that needs no model: signed hashes of character trigrams, of length one."""

    def encode(text: Column) -> Column:
        grams = char_grams(F.concat(F.lit(" "), text, F.lit(" ")), 3, 3)
        cell = lambda g: F.pmod(F.xxhash64(g), F.lit(dim)).cast("int")
        sign = lambda g: F.when(F.pmod(F.xxhash64(g, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        cells = F.transform(grams, lambda g: F.struct(cell(g).alias("c"), sign(g).alias("s")))

        def sums(cs: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(cs, lambda x: x["c"] == i), F.lit(0.0), lambda a, x: a + x["s"])
            )

        return similarity.unit(similarity.let(cells, sums))

    return encode


def same_vocabulary(a: DataFrame, b: DataFrame, column: str = "term") -> bool:
    """Whether two indexes have the same terms, so that a cached one is still valid."""
    return a.select(column).exceptAll(b.select(column)).isEmpty() and b.select(column).exceptAll(a.select(column)).isEmpty()


def alias_tokens(mappings: DataFrame, code: str = "code", text: str = "norm") -> DataFrame:
    """(code, alias_tokens): sorted distinct words of each code's mapped texts."""
    words = mappings.select(code, F.explode(F.split(text, r"\s+")).alias("w")).filter("w <> ''")
    return words.groupBy(code).agg(F.array_sort(F.collect_set("w")).alias("alias_tokens"))


def alias_text(catalog: DataFrame, mappings: DataFrame, code: str = "code", description: str = "description", text: str = "norm", order: str = "ix") -> DataFrame:
    """(code, text): the description, then the code's aliases in order, each once whatever its case, set off by bars."""
    first = mappings.groupBy(code, F.lower(text).alias("__low")).agg(F.min(F.struct(order, text)).alias("m"))
    lists = first.groupBy(code).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    joined = catalog.join(lists, code, "left")
    names = F.transform(F.coalesce("ms", F.array().cast("array<struct<ix:bigint,norm:string>>")), lambda m: m[text])
    return joined.select(code, F.array_join(F.concat(F.array(F.col(description)), names), " | ").alias("text"))


def train_counts(mappings: DataFrame, code: str = "code") -> DataFrame:
    return mappings.groupBy(code).agg(F.count(F.lit(1)).alias("n_train"))


def mapping_stats(mappings: DataFrame, code: str = "code") -> DataFrame:
    """One row: least, upper median and most mappings of a code.

    The median comes from the distribution of counts, a few distinct values, not from
    a list of all codes.
    """
    counts = mappings.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    values = counts.groupBy("n").agg(F.count(F.lit(1)).alias("codes"))
    total = values.agg(F.sum("codes").alias("total"))
    run = F.sum("codes").over(W.orderBy("n"))  # a row for each distinct count
    placed = values.withColumn("upto", run).join(F.broadcast(total))
    return placed.agg(
        F.min("n").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n"))).alias("median"), F.max("n").alias("most")
    )
