from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import similarity as s

words = st.text("AB C", max_size=9)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


@given(words, words)
def test_lcs_is_dynamic_programming(a, b):
    assert s.lcs_length(a, b) == lcs(a, b)


@given(words, words)
def test_ratios_are_symmetric_and_bounded(a, b):
    assert s.indel_ratio(a, b) == s.indel_ratio(b, a) and 0 <= s.indel_ratio(a, b) <= 100
    assert s.token_set_ratio(a, b) == s.token_set_ratio(b, a) and 0 <= s.token_set_ratio(a, b) <= 100


def test_token_set():
    assert s.token_set_ratio("A B", "B A C") == 100 and s.token_set_ratio("", "A") == 0 and s.token_set_ratio("AB", "CD") == 0


def one(spark, *cols, **values):
    df = spark.range(1).select(*[v.alias(k) for k, v in values.items()])
    return tuple(df.select(*cols).first())


def test_scalars(spark):
    text = {"a": F.lit("MRI LLE"), "b": F.lit("MAGNETIC RESONANCE LEFT LOWER EXTREMITY OBLIQUE"), "e": F.lit("")}
    a, b, e = F.col("a"), F.col("b"), F.col("e")
    assert one(spark, s.edit_distance(e, e), s.edit_distance(a, e), s.is_prefix(F.lit("MRI"), a), **text) == (0.0, 1.0, 1.0)
    assert one(spark, F.round(s.abbreviation_score(a, b), 6), s.modifier_penalty(a, b), **text) == (1.0, -40)
    assert one(spark, s.modifier_penalty(e, F.lit("OBLIQUES VIEW")), **text) == (-80,)


def test_points(spark):
    n = lambda x: F.lit(x).cast("int")
    least, exact = F.lit(True), F.lit(False)
    got = one(spark, *[s.view_score(n(a), n(b), m) for a, b, m in ((None, 2, exact), (2, 2, exact), (3, 2, least), (3, 2, exact), (1, 3, exact), (9, 1, exact))])
    assert got == (0, 100, 90, -50, -100, -150)
    kw = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    assert one(spark, *[s.procedure_score(k, F.lit("CT BIOPSY LEGS")) for k in (kw(), kw("STENT"), kw("BIOPSY", "STENT"), kw("RUNOFF"))]) == (0.0, -2.0, 0.5, 1.5)
    assert one(spark, *[s.generic_procedure_score(F.lit("RF PROCEDURE"), F.lit(d)) for d in ("RF PROCEDURE X", "US PROCEDURE", "X")]) == (150, -100, -50)
    assert one(spark, *[s.confidence_band(F.lit(x)) for x in (350, 349, 200, 199)]) == ("HIGH", "MEDIUM", "MEDIUM", "LOW")
    assert one(spark, *[s.display_score(F.lit(x)) for x in (0.05, 0.07, -5.0)]) == (252, 254, 0)  # halves to even


def test_sets_and_vectors(spark):
    arr = lambda *w: F.array(*map(F.lit, w))
    assert one(spark, s.jaccard(arr("a", "b"), arr("b", "c")), s.coverage(arr("a", "b"), arr("b")), s.weighted_overlap(arr("a"), arr("a"))) == (1 / 3, 0.5, 0.5)
    zero, x = arr(0.0, 0.0), arr(3.0, 4.0)
    assert one(spark, s.cosine(zero, x), s.cosine(x, x), s.unit(x), s.unit(zero)) == (0.0, 1.0, [0.6, 0.8], [0.0, 0.0])
