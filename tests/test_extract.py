from pyspark.sql import functions as F

from quillon.functions import extract, rewrite

# text: modality, views, contrast, laterality, plural, late trimester, transvaginal, twins
CASES = {
    "CT head w/wo contrast": ("CT", None, "WWOC", "NONE", False, False, False, False),
    "CT chest without": ("CT", None, "WOC", "NONE", False, False, False, False),
    "MR knee with contrast lt": ("MR", None, "WC", "LEFT", False, False, False, False),
    "knee 3 views right": ("XR", 3, "UNKNOWN", "RIGHT", False, False, False, False),
    "chest pa lat": ("XR", 2, "UNKNOWN", "NONE", False, False, False, False),
    "sinuses": ("XR", None, "UNKNOWN", "NONE", False, False, False, False),
    "breast lt and rt": ("MG", None, "UNKNOWN", "BI-LATERAL", False, False, False, False),
    "cardiac stress": ("NM", None, "UNKNOWN", "NONE", False, False, False, False),
    "CTA neck": ("CT", None, "WC", "NONE", False, False, False, False),
    "US ob >14 wks twins": ("US", None, "UNKNOWN", "NONE", True, True, False, True),
    "US pelvis tv 2nd trimester": ("US", None, "UNKNOWN", "NONE", False, True, True, False),
    "unilateral left breast": ("MG", None, "UNKNOWN", "NONE", False, False, False, False),
    "liver": (None, None, "UNKNOWN", "NONE", False, False, False, False),
}


def parsed(spark, texts, parts=("CALCANEUS", "KNEE", "CHEST")):
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid int, query string")
    vocab = spark.createDataFrame([(p,) for p in parts], "part string")
    return [r.q for r in extract.parse(queries, vocab).orderBy("qid").collect()]


def test_attributes(spark):
    for q, (text, want) in zip(parsed(spark, list(CASES)), CASES.items()):
        got = (q.modality, q.views, q.contrast, q.laterality, q.has_plurality, q.is_late_trimester, q.has_transvaginal, q.has_twins)
        assert got == want, text


def test_body_parts(spark):
    got = [q.body_parts for q in parsed(spark, ["knee and chest", "calcane", "patella xr", "chest knee tibia calcaneus", None])]
    assert got == [["CHEST", "KNEE"], ["CALCANEUS"], ["KNEE"], ["CALCANEUS", "CHEST", "KNEE"], []]


def test_cut_comes_before_drop(spark):
    vocab = F.array(*map(F.lit, ["A", "B", "CT", "D"]))
    df = spark.createDataFrame([("D CT B A",)], "t string")
    assert df.select(extract.body_parts(F.col("t"), vocab, {}, ("CT",))).first()[0] == ["A", "B"]


def test_hints_and_procedures(spark):
    df = spark.createDataFrame([("GALLBLADDER BIOPSY RF PROCEDURE",)], "t string")
    row = df.select(extract.expand_hints(F.col("t")).alias("h"), extract.procedures(F.col("t")).alias("p"), extract.generic_procedure(F.col("t")).alias("g")).first()
    assert row.h == ["GALLBLADDER", "BIOPSY", "RF", "PROCEDURE", "RUQ", "ABDOMEN"] and row.p == ["BIOPSY"] and row.g == "RF PROCEDURE"


def test_catalog_columns(spark):
    df = spark.createDataFrame([("DX", "lt", "WC", "2", "Head/Neck,none"), ("", None, "N/A", "x", None), ("IR", "BILATERAL", "wwoc", "", "HEAD,head")], "m string, l string, c string, v string, r string")
    got = df.select(extract.catalog_modality(F.col("m")), extract.catalog_laterality(F.col("l")), extract.catalog_contrast(F.col("c")), extract.catalog_views(F.col("v")), extract.catalog_regions(F.col("r"))).collect()
    assert list(map(tuple, got)) == [("XR", "LEFT", "WC", 2, ["HEAD", "NECK"]), ("UNKNOWN", "NONE", "UNKNOWN", 1, []), ("XA", "BI-LATERAL", "WWOC", 1, ["HEAD"])]


def test_vocabulary(spark):
    df = spark.createDataFrame([(["Head", " "],), (["KNEE"],)], "region array<string>")
    assert sorted(r[0] for r in extract.body_vocabulary(df, "region", ("KNEE", "HIP")).collect()) == ["HEAD", "HIP", "KNEE"]
    assert rewrite.tokens is not None
