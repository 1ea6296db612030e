import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import rewrite

CASES = {
    "ct head w/wo contrast": "CT HEAD WITH AND WITHOUT CONTRAST",
    "CT chest w/o con": "CT CHEST WITHOUT CONTRAST",
    "CTA abd w runoff": "CT ANGIOGRAM ABDOMEN INCLUDING RUNOFF",
    "xr lt knee 2v": "XR LEFT KNEE 2 VIEW",
    "X-Ray foot 3+ views": "XR FOOT 3 PLUS VIEW",
    "mammo dx bilat": "MG DIAGNOSTIC BILATERAL",
    "shoulder B/L": "SHOULDER BILATERAL",
    "c-spine two views": "CERVICAL SPINE 2 VIEW",
    "PET CT": "PET CT",
    "US preg 3tri twins": "US PREG 3 TRIMESTER TWIN",
    "mri brain wwoc": "MR BRAIN WITH AND WITHOUT CONTRAST",
    "abd/pelvis woc": "ABDOMEN PELVIS WITHOUT CONTRAST",
    "  odd -- (text)\t": "ODD TEXT",
    "": "",
}


def normalized(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", rewrite.normalize(F.col("t"), **kw).alias("n")).orderBy("i").select("n").collect()]


def test_standard_forms(spark):
    assert normalized(spark, list(CASES)) == list(CASES.values())
    assert normalized(spark, [None]) == [""]


def test_standard_form_is_stable(spark):
    once = normalized(spark, [*CASES, "ir picc line lr", "fl or brainlab", "ureteral stent placement", "g-tube tib/fib cvc"])
    assert normalized(spark, once) == once


def test_three_ways_agree(spark):
    texts = [*CASES, "two views a/p & 10 wks", "GJ-TUBE 3V min2 r t", None]
    ways = {impl: normalized(spark, texts, impl=impl) for impl in ("fold", "arrow", "auto")}
    assert ways["fold"] == ways["arrow"] == ways["auto"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("WOCTN/-+& 12VIEWSMINLR().,", max_size=24), min_size=20, max_size=20))
def test_chain_is_arrow_on_noise(spark, texts):
    rules = rewrite.shipped_rules()["contrast"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(rewrite.fold_rules(F.col("t"), rules, "chain").alias("a"), rewrite.fold_rules(F.col("t"), rules, "arrow").alias("b")).collect()
    assert all(r.a == r.b for r in out)


def test_user_rules(spark):
    good = [("foo", "bar"), (r"(\d)x", r"\1 times")]
    assert rewrite.valid_rules([*good, ("(", "x"), ("a", r"\1"), (None, "x"), ("x", None)]) == good
    assert normalized(spark, ["FOO 3x"], user_rules=good) == ["BAR 3 TIMES"]


def test_keys_and_tokens(spark):
    df = spark.createDataFrame([(" a,b\tc \n d ",), (None,)], "t string")
    assert [r[0] for r in df.select(rewrite.mapping_key(F.col("t"))).collect()] == ["A B C D", ""]
    assert [r[0] for r in df.select(rewrite.review_key(F.col("t"))).collect()] == ["A,B C D", ""]
    one = spark.createDataFrame([("a b a  c",)], "t string")
    assert one.select(rewrite.tokens(F.col("t"))).first()[0] == ["a", "b", "c"]


@pytest.mark.parametrize(("text", "java"), [(r"\1 x", "$1 x"), ("a$b", r"a\$b"), ("a\\", r"a\\")])
def test_java_replacement(text, java):
    assert rewrite.java_replacement(text) == java


def test_whole_phrases(spark):
    df = spark.createDataFrame([("RIGHT KNEE 2 VIEW",)], "t string")
    assert tuple(df.select(rewrite.has_phrase(F.col("t"), "KNEE 2"), rewrite.has_phrase(F.col("t"), "NEE")).first()) == (True, False)
