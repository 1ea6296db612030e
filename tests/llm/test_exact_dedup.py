import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    out = []
    for i, t in rows:
        same = [(-len(u or ""), j is None, j or 0, j) for j, u in rows if norm(u) == norm(t)]
        keep = min(same)[3]
        out.append((i, keep, len(same), i == keep and len(t or "") == -min(same)[0], hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string")


CASES = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n"), (7, "Ab"), (8, "a b"), (9, "x" * 70_000), (10, "x" * 69_999 + " x"), (11, "é"), (12, "é")]


@pytest.mark.parametrize("filter_bits", [exact_dedup.FILTER_BITS, 64])
def test_against_brute_force(spark, rows, filter_bits):
    assert rows(exact_dedup.copy_groups(frame(spark, CASES), filter_bits=filter_bits)) == brute(CASES)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text("ab \n", max_size=4), min_size=40, max_size=60))
def test_on_noise(spark, texts):
    data = list(enumerate(texts))
    assert sorted(map(tuple, exact_dedup.copy_groups(frame(spark, data)).collect()), key=repr) == brute(data)


def test_null_ids_and_repeated_rows(spark, rows):
    data = [(None, "a"), (1, "a"), (None, "b"), (2, "c"), (2, "c")]
    got = [r[:4] for r in rows(exact_dedup.copy_groups(frame(spark, data)))]
    assert got == [(1, 1, 2, True), (2, 2, 2, True), (2, 2, 2, True), (None, 1, 2, False), (None, None, 1, True)]
    assert rows(exact_dedup.drop_copies(frame(spark, data))) == [(1, "a"), (2, "c"), (None, "b")]


def test_empty_and_clashing_names(spark, rows, docs):
    assert exact_dedup.copy_groups(frame(spark, [])).count() == 0
    odd = frame(spark, [(1, "a"), (2, "a ")]).selectExpr("*", "'k' AS keep_id", "1 AS kept", "2 AS h", "3 AS bit")
    assert rows(exact_dedup.drop_copies(odd)) == [(2, "a ", "k", 1, 2, 3)]
    assert exact_dedup.copy_groups(odd).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_hot_group(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.copy_groups(df)
    assert out.filter("kept").count() == 2001 and out.filter("group_size = 1000 AND keep_id = 0").count() == 1000


def test_most_unique_rows_pass_straight_through(spark):
    keyed = exact_dedup.keys(spark.range(20_000).selectExpr("id AS doc_id", "uuid() AS text")).cache()
    blocks = 20_000 * exact_dedup.BITS_PER_ROW // exact_dedup.BLOCK_BITS
    marked = exact_dedup.suspects(keyed, exact_dedup.repeat_filter(keyed, blocks).drop("__dd_slice"), blocks)
    assert marked.filter("__dd_seen").count() < 600  # false alarms only


def test_several_slices_read_the_corpus_twice_at_most(spark, rows):
    n = 3000
    df = spark.range(n).selectExpr("id AS doc_id", "concat('text ', IF(id % 3 = 0, 'hot', CAST(id DIV 2 AS string))) AS text")
    read = spark.sparkContext.accumulator(0)

    @exact_dedup.F.udf("string")
    def seen(text):
        read.add(1)
        return text

    bits = n * exact_dedup.BITS_PER_ROW // 8
    counted = df.select("doc_id", seen("text").alias("text"))
    got = rows(exact_dedup.drop_copies(counted, filter_bits=bits))
    assert got == rows(exact_dedup.drop_copies(df)) and read.value <= 2 * n
    assert rows(exact_dedup.copy_groups(df, filter_bits=bits)) == rows(exact_dedup.copy_groups(df))
