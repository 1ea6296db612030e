import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import language_id as li

VOCAB = {"aa": ["the", "thing", "other", "with", "thrown"], "bb": ["und", "schön", "zeit", "nicht", "pfund"], "cc": ["это", "слово", "мир"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rng, data = random.Random(1), []
    for i in range(300):
        lang = "abc"[i % 3] * 2
        data.append((i, " ".join(rng.choices(VOCAB[lang], k=30)), lang))
    return spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark, labelled):
    got = li.predict(labelled).join(labelled, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.lang == r.lang_pred and r.score > 0.9 for r in got) and any(r.held_out for r in got)


def test_labels_of_held_out_documents_are_not_used(spark, labelled):
    from pyspark.sql import functions as F

    twisted = labelled.withColumn("lang", F.when(li.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert sorted(map(tuple, li.predict(twisted).collect())) == sorted(map(tuple, li.predict(labelled).collect()))


def test_spans(spark, labelled):
    model = li.train(labelled)
    text = "the thing with other thrown thing -- und nicht schön zeit und. это слово"
    (row,) = li.label_spans(spark.createDataFrame([(text,)], "text string"), model).collect()
    assert [(text[s.start : s.end], s.lang) for s in row.spans] == [("the thing with other thrown thing", "aa"), ("und nicht schön zeit und", "bb"), ("это слово", "cc")]


def test_script_narrows_candidates(spark, labelled):
    model = li.train(labelled)
    assert model.score(["мир"])[0].argmax() == 2 and (model.score(["мир"])[0][:2] < -1000).all()
    assert (model.score(["ගස"])[0] > -1000).all()  # a script that no language has leaves all
    assert [li.script(w) for w in ("a", "я", "漢", "한", "ひ", "ع", "é")] == ["Latin", "Cyrillic", "Han", "Hangul", "Kana", "Arabic", "Latin"]


@settings(deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.integers(-9, 0)] * 3), max_size=5), max_size=6), st.integers(0, 6))
def test_viterbi_is_best_path(docs, switch):
    scores = [np.array(d, dtype=np.float32).reshape(len(d), 3) for d in docs]
    for s, labels in zip(scores, li.viterbi(scores, switch)):
        value = lambda p: sum(s[t, k] for t, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
        assert len(labels) == len(s)
        if len(s):
            assert value(labels) == max(map(value, itertools.product(range(3), repeat=len(s))))


def test_edge_cases(spark, labelled, rows):
    odd = spark.createDataFrame([(None, None, "aa"), (1000, "", None), (1001, "12 !! 34", "bb"), (1002, "the thing " * 60_000, None), (1003, "und", None), (1003, "und", None)], labelled.schema)
    got = {(r[0], r[2], r[3]) for r in rows(li.predict(labelled.union(odd)))}
    assert {(None, "und", 0.0), (1000, "und", 0.0), (1001, "und", 0.0), (1002, "aa", 1.0), (1003, "bb", 1.0)} <= got
    assert li.predict(labelled.limit(0)).count() == 0
    unlabelled = labelled.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {r[2:] for r in rows(li.predict(unlabelled))} == {("und", 0.0)}


def test_filter_keeps_clean_documents(spark, labelled):
    odd = spark.createDataFrame([(2000, "1234", "aa"), (2001, None, "aa")], labelled.schema)
    kept = li.keep_known(labelled.union(odd).selectExpr("*", "'x' AS lang_pred", "5 AS score"))
    assert kept.count() == 300 and kept.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and kept.first().score == 5


def test_letters_beside_numerals_and_vowel_signs(spark, labelled, rows):
    odd = spark.createDataFrame([(3000, "x²", None), (3001, "m² n³", None), (3002, "² ½", None), (3003, "हिन्दी", None)], labelled.schema)
    got = {r[0]: r[2] for r in rows(li.predict(labelled.union(odd)))}
    assert got[3000] != "und" and got[3001] != "und" and got[3003] != "und" and got[3002] == "und"
    assert li.WORD.findall("हिन्दी भाषा x² 12a_b") == ["हिन्दी", "भाषा", "x²", "a", "b"]


def test_two_hundred_languages(spark, rows):
    names = [f"l{i:03d}" for i in range(200)]
    word = lambda i: "".join(chr(97 + (i // 26**k * 7 + k) % 26) for k in range(2)) + "qx" + chr(97 + i % 26) * 3
    data = [(4 * i + k, " ".join([word(i)] * 8), names[i]) for i in range(200) for k in range(12)]
    df = spark.createDataFrame([(i, t, n) for i, (_, t, n) in enumerate(data)], "doc_id long, text string, lang string")
    want = {r.doc_id: r.lang for r in df.collect()}
    got = {r[0]: r[2] for r in rows(li.predict(df))}
    assert sum(got[i] == want[i] for i in want) > 0.95 * len(want) and len(set(got.values())) > 190


@settings(deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(0, 6), st.integers(1, 9))
def test_long_texts_go_through_in_parts(doc, switch, cells):
    table = np.random.default_rng(0).integers(-9, 0, (6, 3)).astype(np.float32)
    ids, before = np.array(doc), li.CELLS
    try:
        li.CELLS = cells
        got = li.viterbi_long(ids, table, switch)
    finally:
        li.CELLS = before
    value = lambda p: sum(table[w, k] for w, k in zip(doc, p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
    (want,) = li.viterbi([table[ids]], switch)
    assert value(got) == value(want)
