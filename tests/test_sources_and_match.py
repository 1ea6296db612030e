import json
from datetime import date, datetime
from functools import partial

import pytest
from pyspark.sql import functions as F

from quillon.functions import similarity
from quillon.operators import blocks, index, learn, retrieve
from quillon.plans import training
from quillon.plans.match import Matcher, hinted, legacy_match, legacy_pairs, responses
from quillon.sources import readers
from quillon.storage import stash
from quillon.streaming import feedback

CATALOG = """﻿Code,Laterality,Contrast,XR#Views,description,modality,bodyRegion
C1,N/A,WOC,1,CT Head wo IV Contrast,CT,HEAD
C2,N/A,WC,1,CT Head w IV Contrast,CT,HEAD
C3,LEFT,N/A,2,XR Knee Left 2 Views,XR,KNEE
C4,RIGHT,N/A,2,XR Knee Right 2 Views,XR,KNEE
C5,N/A,N/A,1,US Pelvis,US,"PELVIS/ABDOMEN"
,N/A,N/A,1,no code,US,PELVIS
111188940,N/A,N/A,1,a test row,US,PELVIS
"""
MAPPINGS = 'xr lt knee,C3,note\n"belly, sono",C5,\nbelly sono,C4,\nonly one cell\nunknown,ZZ,\n'


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "catalog.csv").write_text(CATALOG, encoding="utf-8")
    (d / "mappings.csv").write_text(MAPPINGS)
    return d


@pytest.fixture(scope="module")
def matcher(spark, files):
    cat = readers.enrich_catalog(readers.read_catalog_csv(spark, str(files / "catalog.csv")), ignored=("111188940",)).cache()
    return Matcher(cat, readers.read_mappings(spark, str(files / "mappings.csv"), cat).cache())


def test_readers(spark, files, rows, matcher, tmp_path):
    assert rows(matcher.catalog.select("code", "modality", "views", "contrast", "laterality")) == [
        ("C1", "CT", 1, "WOC", "NONE"), ("C2", "CT", 1, "WC", "NONE"), ("C3", "XR", 2, "UNKNOWN", "LEFT"), ("C4", "XR", 2, "UNKNOWN", "RIGHT"), ("C5", "US", 1, "UNKNOWN", "NONE"),
    ]
    assert rows(matcher.mappings.select("query", "code")) == [("belly sono", "C4"), ("belly, sono", "C5"), ("xr lt knee", "C3")]
    (tmp_path / "bad.csv").write_text("Code,other\n1,2\n")
    with pytest.raises(ValueError, match="description"):
        readers.read_catalog_csv(spark, str(tmp_path / "bad.csv"))


def test_rules_and_settings(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"replacements": [{"pattern": "a", "replacement": "b"}, {"pattern": "("}, 3]}))
    (tmp_path / "l.json").write_text(json.dumps([{"pattern": "a", "replacement": ""}]))
    assert readers.read_rules(spark, str(tmp_path / "r.json")) == [("a", "b")] and readers.read_rules(spark, str(tmp_path / "l.json")) == [("a", "")]
    s = readers.Settings.merged({"min_score": "100", "max_results": "x", "review": True, "api_key": "secret-key", "else": 1})
    readers.write_rules(spark, [("a", "b"), ("(", "x")], str(tmp_path / "w"))
    assert readers.read_rules(spark, str(tmp_path / "w")) == [("a", "b")]
    readers.write_settings(spark, s, str(tmp_path / "s"))
    assert readers.read_settings(spark, str(tmp_path / "s")) == s
    readers.write_template(spark, str(tmp_path / "t"))
    assert readers.enrich_catalog(readers.read_catalog_csv(spark, str(tmp_path / "t"))).count() == 2
    assert (s.min_score, s.max_results) == (100, 15) and s.shown()["api_key"] == "******-key" and s.can_suggest()


def test_writers_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("a, \"b\"", "1", "n")], "query string, code string, note string")
    readers.write_mappings_csv(df, str(tmp_path / "m"))
    back = spark.read.schema(readers.MAPPING).option("escape", "\\").csv(str(tmp_path / "m"))
    assert rows(back) == rows(df)


def test_match(spark, matcher):
    asks = spark.createDataFrame([(1, "head ct without contrast"), (2, "xr lt knee"), (3, "knee r 2v"), (4, "belly sono"), (5, ""), (6, None), (7, "us pelvis")], "qid int, query string")
    out = {}
    for r in matcher.match(asks, 3).collect():
        out.setdefault(r.qid, []).append(r)
    best = {q: min(rs, key=lambda r: r["rank"] or 9) for q, rs in out.items()}
    assert {q: r.code for q, r in best.items() if q < 5} == {1: "C1", 2: "C3", 3: "C4", 4: "C4"} and best[7].code == "C5"
    assert best[2].is_exact and best[4].is_exact and not best[1].is_exact
    assert all([r["rank"] for r in sorted(rs, key=lambda r: r["rank"])] == list(range(1, len(rs) + 1)) for rs in out.values() if rs[0]["rank"])
    assert set(out) == {1, 2, 3, 4, 5, 6, 7}
    single = {(r.qid, r["rank"], r.code, r.score) for r in matcher.match(asks.filter("qid = 3"), 3).collect()}
    assert single == {(r.qid, r["rank"], r.code, r.score) for r in out[3]}


def test_hints_logs_and_responses(spark, matcher):
    asks = spark.createDataFrame([(1, "head wo", "CT"), (2, "xr knee lt 2v", None), (3, "zzz", "QQ")], "qid int, query string, hint string")
    assert [r.query for r in hinted(asks).orderBy("qid").collect()] == ["CT head wo", "xr knee lt 2v", "QQ zzz"]
    rows = matcher.match(asks, 2)
    for r in rows.filter("code IS NOT NULL").collect():
        assert r.score_log[-1].component == "TOTAL" and r.score_log[-1].value == int(r.score) and (r.is_exact or r.score == 0 or abs(sum(x.value for x in r.score_log[:-1]) - r.score) <= 1)
    got = {r.qid: r for r in responses(rows).collect()}
    assert got[1].matches[0].code == "C1" and got[1].modality == "CT" and got[2].views == 2 and got[2].body_parts == ["KNEE"] and got[2].top_ok
    assert len(got) == 3 and not got[3].top_ok


def test_verified_row_without_any_match_gets_a_log(spark, matcher):
    (r,) = matcher.match(spark.createDataFrame([(1, "belly sono")], "qid int, query string"), 1).collect()
    assert r.code == "C4" and r.is_exact and r.score_log[-1].component == "TOTAL"


def test_training(spark, matcher, tmp_path):
    few = training.examples_of(matcher.mappings)
    assert training.train(matcher, few) is None
    texts = {"C1": "ct head w/o contrast", "C2": "ct head w contrast", "C3": "knee left xr", "C4": "right knee 2 views", "C5": "pelvis us"}
    many = spark.createDataFrame([(i, t + " x" * (i % 3), c) for i, (c, t) in enumerate(list(texts.items()) * 24)], "qid int, query string, gold string")
    ranker = training.train(matcher, many)
    asks = many.select("qid", "query").limit(10)
    top = matcher.match(asks, 1, ranker).join(many.select("qid", "gold"), "qid")
    assert top.filter("code = gold").count() >= 9 and top.first().method == "RANKER"
    ranker.save(spark, str(tmp_path / "ranker"))
    again = learn.Ranker.load(spark, str(tmp_path / "ranker"))
    assert again.weights == ranker.weights and again.names == ranker.names and (again.calibration is None) == (ranker.calibration is None)


def test_schedule():
    assert training.due(datetime(2024, 1, 2, 3), "02:30", date(2024, 1, 1)) and not training.due(datetime(2024, 1, 2, 3), "02:30", date(2024, 1, 2))
    assert not training.due(datetime(2024, 1, 2, 1), "02:30", None) and not training.due(datetime(2024, 1, 2, 1), "x", None)


def test_feedback_stream(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("q1,A,\nq2,B,own\n")
    state = str(tmp_path / "state")
    merge = feedback.latest_merger(spark, state, "query", "code")
    for k, extra in enumerate(("", "q1,Z,\nq3,C,\n")):
        if extra:
            (tmp_path / "in" / "2.csv").write_text(extra)
        feedback.apply_batches(feedback.watch_mappings(spark, str(tmp_path / "in"), "own"), merge, str(tmp_path / "log")).awaitTermination()
        assert rows(spark.read.parquet(f"{state}/v={k}").select("query", "code")) == ([("q1", "A")], [("q1", "Z"), ("q3", "C")])[k]


def test_pending_stream_keeps_one_of_a_key(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("Knee  a,A,\nknee A,B,\nhip,C,\n")
    got = []
    feedback.apply_batches(feedback.pending_queue(feedback.watch_mappings(spark, str(tmp_path / "in"))), lambda df, i: got.extend(r.key for r in df.collect()), str(tmp_path / "log")).awaitTermination()
    assert sorted(got) == ["HIP", "KNEE A"]


def test_incremental_aliases(spark, rows):
    maps = spark.createDataFrame([("a", "x y"), ("b", "z")], "code string, norm string")
    more = maps.union(spark.createDataFrame([("a", "w")], "code string, norm string"))
    fresh = feedback.refresh_aliases(index.alias_tokens(maps), more.filter(F.col("norm") == "w"), more)
    assert rows(fresh) == rows(index.alias_tokens(more))


def test_index(spark):
    df = spark.createDataFrame([("a", "knee left"), ("b", "knee right"), ("c", "")], "id string, t string")
    counts = index.term_counts(df, "id", index.word_grams(F.col("t")))
    w = index.weights(counts, index.vocabulary(counts, 3), "id")
    sims = {(r.a, r.b): r.sim for r in index.sparse_cosine(w.withColumnRenamed("id", "a"), w.withColumnRenamed("id", "b"), "a", "b").collect()}
    assert sims["a", "a"] == pytest.approx(1) and 0 < sims["a", "b"] < 1 and ("c", "c") not in sims
    assert index.same_vocabulary(w.select("term").distinct(), w.select("term").distinct()) and not index.same_vocabulary(w.filter("id = 'a'"), w)


def test_late_batches_do_not_displace_newer_rows(spark, tmp_path, rows):
    frame = lambda data: spark.createDataFrame(data, "k string, at int, v string")
    merge = feedback.latest_merger(spark, str(tmp_path / "s"), "k", "at")
    batches = ([("a", 5, "new"), ("b", 1, "old")], [("a", 3, "late"), ("b", 2, "newer"), ("c", 1, "c")], [("c", 1, "again")])
    want = ([("a", "new"), ("b", "old")], [("a", "new"), ("b", "newer"), ("c", "c")], [("a", "new"), ("b", "newer"), ("c", "again")])
    for i, (batch, state) in enumerate(zip(batches, want)):
        for _ in range(2):  # a repeated batch changes nothing
            merge(frame(batch), i)
        assert rows(spark.read.parquet(f"{tmp_path}/s/v={i}").select("k", "v")) == state


def test_saved_and_refreshed_matcher(spark, matcher, tmp_path, rows):
    asks = spark.createDataFrame([(1, "head ct without contrast"), (2, "xr lt knee"), (3, "leg film")], "qid int, query string")
    told = lambda m: rows(m.match(asks, 2).select("qid", "rank", "code", "score", "is_exact"))
    matcher.save(str(tmp_path / "m"))
    again = Matcher.load(spark, str(tmp_path / "m"))
    assert told(again) == told(matcher)
    batch = spark.createDataFrame([(99, "leg film", "C4", None, "LEG FILM")], matcher.mappings.select("ix", "query", "code", "note", "norm").schema)
    every = matcher.mappings.select(*batch.columns).unionByName(batch)
    fresh, full = again.refreshed(batch, every), Matcher(matcher.catalog, every)
    for name in ("aliases", "counts", "exact"):
        assert rows(getattr(fresh, name)) == rows(getattr(full, name).select(*getattr(fresh, name).columns))
    assert rows(fresh.texts.select("code", "text")) == rows(full.texts.select("code", "text"))
    assert [r[2] for r in told(fresh) if r[0] == 3 and r[4]] == ["C4"]


def test_tree_ranker(spark, tmp_path):
    data = [(q, c, int(c == q % 5), float((c - q) % 5), float((7 * c + q) % 3)) for q in range(40) for c in range(5)]
    train = spark.createDataFrame(data, "qid int, code int, label int, f_a double, f_b double")
    ranker = learn.fit_tree_ranker(train, ["f_a", "f_b"], rounds=3, depth=2)
    first = lambda r: training.rank.ranked(r.score(train), 1, score="raw", tie="code").filter("label = 1").count()
    assert first(ranker) == 40
    ranker.save(spark, str(tmp_path / "t"))
    assert first(learn.TreeRanker.load(spark, str(tmp_path / "t"))) == 40
    sizes = learn.group_sizes(train)
    assert sizes.filter("rows = 5 AND positives = 1").count() == 40


def test_legacy_match(spark, matcher):
    asks = spark.createDataFrame([(1, "ct head wo contrast", "C1"), (2, "ct head w contrast", "C2"), (3, "xr knee lt 2v", "C3"), (4, "xr knee rt 2v", "C4"), (5, "us pelvis", "C5")], "qid int, query string, gold string")
    pairs = legacy_pairs(matcher, matcher.parsed(asks)).withColumn("label", (F.col("code") == F.col("gold")).cast("int"))
    names = [c for c in pairs.columns if c.startswith("l_")]
    assert len(names) == 19
    forest = learn.fit_forest(pairs.select("label", *names), names, trees=5, depth=4)
    top = legacy_match(matcher, asks, forest, 1).collect()
    assert {r.qid: r.code for r in top} == {1: "C1", 2: "C2", 3: "C3", 4: "C4", 5: "C5"} and all(r.method == "ML_MATCH" for r in top)


@pytest.mark.parametrize("size", [(2, 2), (blocks.QUERIES, blocks.CODES)])
def test_candidates_by_blocks_are_those_of_all_pairs(spark, matcher, monkeypatch, size):
    texts = ["head ct without contrast", "xr lt knee", "knee", "belly sono", "", None, "zzz", "pelvis us", "CT HEAD WITHOUT CONTRAST"]
    parsed = matcher.parsed(spark.createDataFrame(list(enumerate(texts)), "qid int, query string"))
    encoded = parsed.select("qid", matcher.encoder(F.col("normalized")).alias("qv"))
    dense = retrieve.full_scan(encoded, matcher.texts).select("qid", "code", F.round(similarity.dot(F.col("qv"), F.col("cv")), 12).alias("embed_sim"))
    sims = {n: matcher.sims(parsed, n).withColumn(f"{n}_sim", F.round(f"{n}_sim", 12)) for n in ("char", "word")}
    asked = parsed.select("qid", F.col("q.modality").alias("modality"))
    pools = [retrieve.blocked(asked, matcher.catalog.select("code", "modality"), "modality"), retrieve.pool_of(dense, 2, sim="embed_sim")]
    want = retrieve.candidates(*pools, *[retrieve.pool_of(s, 2, sim=f"{n}_sim") for n, s in sims.items()])
    for s in (*sims.values(), dense):
        want = want.join(s, ["qid", "code"], "left")
    monkeypatch.setattr(blocks, "candidates", partial(blocks.candidates, size=size))
    told = lambda df: {(r.qid, r.code): (r.pool, *[pytest.approx(x, abs=1e-11) if x is not None else None for x in (r.char_sim, r.word_sim, r.embed_sim)]) for r in df.collect()}
    got = matcher.candidates(parsed, 2).collect()
    assert {(r.qid, r.code): (r.pool, r.char_sim, r.word_sim, r.embed_sim) for r in got} == told(want) and len(got) == len(told(want))
    assert {r.pool for r in got} >= {0, 1} and any(r.char_sim is None for r in got)


def test_equal_texts_are_matched_once_and_alike(spark, matcher, monkeypatch):
    texts = ["xr lt knee", "CT Head w IV Contrast", None, "zzz"]
    asks = spark.createDataFrame([(i, texts[i % 4]) for i in range(200)], "qid int, query string")
    parsed, seen = Matcher.parsed, []

    def watched(self, queries, *rest):
        out = parsed(self, queries, *rest)
        seen.append(out.count())
        return out

    monkeypatch.setattr(Matcher, "parsed", watched)
    got = {}
    for r in matcher.match(asks, 2).collect():
        got.setdefault(r.qid, []).append((r["rank"] or 0, r.original, r.normalized, r.code, r.score, r.score_log))
    assert seen == [4] and sorted(got) == list(range(200))
    assert all(sorted(got[i]) == sorted(got[i % 4]) and got[i][0][1] == texts[i % 4] for i in got)


def test_the_same_text_has_a_cosine_of_one(spark):
    words = " ".join(f"w{i}x{i * i}" for i in range(40))
    docs = spark.createDataFrame([(str(i), words if i < 20 else f"{words} y{i}") for i in range(40)], "code string, text string")
    counts = index.term_counts(docs, "code", index.char_grams(F.col("text")))
    vocab = index.vocabulary(counts, 40)
    codes = docs.select("code", F.lit("XR").alias("modality"), F.lit(None).cast("array<double>").alias("cv"))
    for name in blocks.SPARSE:
        codes = codes.join(blocks.vectors(index.weights(counts, vocab, "code"), vocab, "code", name), "code")
    asks, codes = stash(codes.withColumnRenamed("code", "qid").withColumnRenamed("cv", "qv")), stash(codes)
    sims = {(r.qid, r.code): r for r in blocks.candidates(asks, codes, 3, (8, 16)).collect()}
    assert len(sims) == 1600 and all(sims[str(i), str(j)].char_sim == 1.0 for i in range(20) for j in range(20))
    assert all(r.embed_sim is None and r.pool == 0 for r in sims.values()) and sims["0", "25"].char_sim < 1
