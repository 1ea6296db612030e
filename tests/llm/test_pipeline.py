import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import queries
from quillon.llm.simhash import fingerprint

DATA = "/root/testdata/sf0.001"


def test_stages_on_planted_cases(spark, docs):
    words = [f"{a}{b}" for a in ("the ", "thing ", "other ") for b in ("with", "thrown", "though")]
    clean = [" ".join(words[(i * k + k) % 9] + str(i) for k in range(60)) for i in range(40)]
    changed = (clean[3].replace(w, "changed", 1) for w in clean[3].split(" ")[5:])
    near = next(t for t in changed if (fingerprint(t) ^ fingerprint(clean[3])).bit_count() <= 4)
    table = docs(*clean, clean[0] + " ", near, "1234 5678", None)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").distinct().collect())
    (_, known), (_, copies), (_, nears), (_, mixed), (_, packed) = corpus_pipeline.STAGES
    one = known(spark, table, "")
    assert ids(one) == list(range(42)) and one.columns == table.columns
    two = copies(spark, one, "")
    assert ids(two) == [*range(1, 42)] and two.columns == table.columns  # the longer original, 40, stays
    three = nears(spark, two, "")
    assert ids(three) == [*range(1, 41)] and three.columns == table.columns
    four = mixed(spark, three, "").cache()
    n = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert four.columns == table.columns and n(four) == int(1.5 * n(three)) and ids(four) == ids(three)
    five = packed(spark, four, "")
    assert ids(five) == ids(four)


def test_nothing_nulls_and_other_columns(spark, docs):
    """Each stage gives the columns that it got (the last its pieces), also of nothing and of rows of nulls."""
    odd = docs((None, None, None, None, None), (1, "the with other", None, "s", 14), (1, "the with other", None, "s", 14)).selectExpr("*", "1 AS key", "'x' AS component", "2 AS size")
    for table in (odd.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "")
            assert out.columns == table.columns or name == "packing"
            assert out.count() <= 3 * table.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024 and out.count() > 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    cell = lambda v: "-" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    shown = lambda df: sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert shown(queries.QUERIES[name](spark, DATA).toPandas()) == shown(db.sql(queries.ORACLES[name]).df())
