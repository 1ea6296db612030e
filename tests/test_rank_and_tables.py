from datetime import datetime

from pyspark.sql import functions as F

from quillon.operators import generate, index, learn, rank, retrieve, score, suggest, tables


def scored(spark):
    return spark.createDataFrame([(1, "a", 0, 300), (1, "b", 1, 300), (1, "c", 2, 100), (2, "a", 0, 50)], "qid int, code string, code_ix int, score int")


def test_ties_go_by_catalog_order(spark, rows):
    assert rows(rank.ranked(scored(spark), 2).select("qid", "code", "rank")) == [(1, "a", 1), (1, "b", 2), (2, "a", 1)]
    assert rows(rank.margin(scored(spark))) == [(1, 300, 0), (2, 50, 50)]


def test_promotion(spark, rows):
    best = rank.ranked(scored(spark), 3)
    verified = spark.createDataFrame([(1, "c"), (2, "z"), (3, "z"), (4, None)], "qid int, verified_code string")
    cat = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("z", 9)], "code string, code_ix int")
    out = rank.promote(best, verified, cat, 3).select("qid", "rank", "code", "score", "is_exact")
    assert rows(out) == [(1, 1, "c", 301, True), (1, 2, "a", 300, False), (1, 3, "b", 300, False), (2, 1, "z", 51, True), (2, 2, "a", 50, False), (3, 1, "z", 400, True)]


def test_policy(spark, rows):
    assert rows(rank.annotate(scored(spark), 220)) == [(1, 220, 300, True, None), (2, 220, 50, False, 50)]
    gate = spark.range(1).select(*[rank.needs_review(F.lit(s).cast("int"), F.lit(e), m) for s, e, m in ((240, False, 0), (260, False, 0), (10, True, 220), (None, False, 220))])
    assert tuple(gate.first()) == (True, False, False, True)
    floored = rank.floor_exact(scored(spark).withColumn("is_exact", F.col("qid") == 2))
    assert floored.filter("qid = 2").first().score == 220


def test_blocks_and_pools(spark, rows):
    q = spark.createDataFrame([(1, "x"), (2, None)], "qid int, block string")
    c = spark.createDataFrame([("a", "x"), ("b", "y")], "code string, block string")
    pairs = retrieve.blocked(q, c, "block")
    assert rows(pairs.select("qid", "code")) == [(1, "a"), (2, "a"), (2, "b")]
    assert rows(retrieve.candidates(pairs, q.select("qid", F.lit("b").alias("code")))) == [(1, "a", 0), (1, "b", 1), (2, "a", 0), (2, "b", 0)]


def test_exact_map(spark, rows):
    maps = spark.createDataFrame([("n", "a", 1), ("n", "b", 2), ("m", "gone", 3)], "norm string, code string, ix int")
    assert rows(retrieve.exact_map(maps, spark.createDataFrame([("a",), ("b",)], "code string"))) == [("n", "b")]


def test_score_log_adds_up(spark):
    points = {"one": F.lit(100), "none": F.lit(0), "two": F.lit(-30)}
    row = spark.range(1).select(score.rule_score(points).alias("s"), score.score_log(points, score.rule_score(points)).alias("log")).first()
    assert row.s == 70 and [(x.component, x.value) for x in row.log] == [("one", 100), ("two", -30), ("TOTAL", 70)]
    assert spark.range(1).select(score.rule_score({"x": F.lit(-5)})).first()[0] == 0


def test_boosts(spark, rows):
    out = score.boosts(scored(spark), [("a", "qid = 2", 175)]).select("qid", "code", "score")
    assert (2, "a", 225) in rows(out) and (1, "a", 300) in rows(out)


def test_upserts(spark, rows):
    old = spark.createDataFrame([("Chest, pa", "1", ""), ("knee", "2", "")], "query string, code string, note string")
    new = spark.createDataFrame([("chest  pa", "3", "n", 1), ("CHEST PA", "4", "n", 2), ("hip", "5", "n", 3)], "query string, code string, note string, ix int")
    assert rows(tables.upsert_mappings(old, new)) == [("CHEST PA", "4", "n"), ("hip", "5", "n"), ("knee", "2", "")]
    assert tuple(tables.upsert_counts(old, new, "code").first()) == (3, 0)


def test_catalog_changes(spark, rows):
    cat = spark.createDataFrame([("A1", 1)], "code string, ix int")
    up = spark.createDataFrame([("a1", 2), ("B", 3), ("b ", 4), (" ", 5)], "code string, ix int")
    assert rows(tables.upload(cat, up)) == [("A1", 1), ("B", 3)]
    assert rows(tables.upload(None, up)) == [("B", 3), ("a1", 2)]
    assert rows(tables.insert_code(cat, up.filter("ix < 4"))) == [("A1", 1), ("B", 3)]
    assert tables.rename_allowed(cat, "ix", 1, "a1") and not tables.rename_allowed(cat, "ix", 2, "a1")
    assert rows(tables.update_row(cat, "ix", 1, {"code": "Z"})) == [("Z", 1)] and rows(tables.delete_rows(cat, "ix", [1])) == []


def test_history(spark, rows):
    at = lambda h: datetime(2024, 1, 1, h)
    data = [(1, at(0), "q", "n1", "a", "d", "RULES", None), (2, at(5), "q", "n1", "b", "d", "EXACT_MATCH", None), (3, at(6), "r", "n2", "c", "d", None, None)]
    h = spark.createDataFrame(data, "id long, created_at timestamp, query string, normalized string, code string, description string, method string, corrected_code string")
    assert rows(tables.retain(h, most=2).select("id")) == [(2,), (3,)]
    assert [r.id for r in tables.page(h, 0, -5).collect()] == [3] and [r.id for r in tables.page(h, 9, 1).collect()] == [2, 1]
    assert rows(tables.export(h)) == [("q", "a", "d")]
    assert tuple(tables.stats(h, F.lit(at(6)), "created_at").first()) == (3, 2, 3, 0.1, 0.0)
    fix = spark.createDataFrame([("n1", "z"), ("n2", "c")], "normalized string, code string")
    assert rows(tables.backfill(h, fix).select("id", "corrected_code")) == [(1, None), (2, "z"), (3, None)]


def test_empty_tables(spark):
    h = spark.createDataFrame([], "id long, ts timestamp")
    assert tables.retain(h).count() == 0 and tables.stats(h, F.current_timestamp()).first().total == 0
    assert index.mapping_stats(spark.createDataFrame([], "code string")).first().least is None


def test_median_of_counts(spark):
    df = spark.createDataFrame([(c,) for c in "aabccccdddd"], "code string")
    assert tuple(index.mapping_stats(df).first()) == (1, 4, 4)


def test_variants(spark, rows):
    cat = spark.createDataFrame([("1", "XR Knee Left 2 Views"), ("2", "MR Head Angio")], "code string, description string")
    got = rows(generate.training_pairs(cat, generate.rule_table(spark), most=25))
    texts = {t for c, t in got if c == "1"}
    assert {"XR Knee Left 2 Views", "X-Ray Knee LT 2 Views", "XR Knee L 2V", "Radiograph Knee Left 2 Views"} <= texts
    assert ("2", "MRA Head") in got and ("2", "MR Head Angio") in got
    assert max(sum(c == k for c, _ in rows(generate.training_pairs(cat, generate.rule_table(spark)))) for k in "12") <= 9


def test_suggestions(spark, rows):
    assert suggest.balanced_object('a } {"x": "}{\\"", "y": {"z": 1}} tail') == '{"x": "}{\\"", "y": {"z": 1}}'
    assert suggest.balanced_object("{ never closed") is None and suggest.balanced_object(None) is None
    cand = spark.createDataFrame([(1, "q", "a", "first", "CT"), (1, "q", "b", "second", None)], "qid int, query string, code string, description string, modality string")
    answers = suggest.ask(suggest.prompts(cand)).withColumn("a", suggest.read_answer(suggest.first_object(F.col("answer")))).select("qid", "a.code", "a.confidence")
    assert rows(answers) == [(1, "a", 0.5)] and rows(suggest.guarded(answers, cand).select("code")) == [("a",)]
    bad = spark.createDataFrame([(1, "zz"), (1, None), (1, "unclassified")], "qid int, code string")
    assert suggest.guarded(bad, cand).isEmpty()


def test_review_queue(spark, rows):
    new = spark.createDataFrame([(1, "Knee  x", "a", 2), (2, "knee X", "b", 1), (3, "hip", "c", 3)], "id int, query string, suggested_code string, created_at int")
    queue = suggest.enqueue(new.limit(0), new)
    assert rows(queue.select("id")) == [(2,), (3,)] and rows(suggest.enqueue(queue, new).select("id")) == [(2,), (3,)]
    left, add = suggest.agree(queue, [2])
    assert rows(left.select("id")) == [(3,)] and rows(add) == [("knee X", "b")]


def test_learning(spark):
    data = [(q, c, int(c == q % 5), float(c == q % 5) + (q * 7 + c * 3) % 10 / 10, float((q + c) % 3)) for q in range(60) for c in range(5)]
    df = spark.createDataFrame(data, "qid int, code int, label int, f_a double, f_b double").withColumn("code_ix", F.col("code"))
    ranker = learn.fit_ranker(learn.negatives(df, most=3), ["f_a", "f_b"])
    assert ranker.weights[0] > abs(ranker.weights[1])
    held = ranker.score(df)
    first = rank.ranked(held, 1, score="raw").select("qid", F.col("label").alias("correct"))
    margins = rank.margin(held, score="raw").join(first, "qid")
    assert ranker.confidence(margins).filter("calibrated_confidence IS NOT NULL").isEmpty()
    conf = learn.calibrate(ranker, margins).confidence(margins).agg(F.min("calibrated_confidence"), F.max("calibrated_confidence")).first()
    assert 0 <= conf[0] <= conf[1] <= 1
    train, out = learn.holdout(df.select("qid").distinct(), "qid", least=10)
    assert (train.count(), out.count()) == (50, 10)


def test_pairwise_ranking_without_writing_out_pairs(spark, monkeypatch):
    """The weights are those of logistic regression over all differences; no plan joins row by row."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(3)
    table = [(int(q), int(y), float(a + 0.8 * y), float(b), 1.0) for q, y, a, b in zip(rng.integers(0, 9, 600), rng.integers(0, 2, 600), rng.normal(size=600), rng.normal(size=600))]
    rows, names = spark.createDataFrame(table, "qid int, label int, x double, y double, same double"), ["x", "y", "same"]
    good, bad = (rows.filter(f"label = {k}").select("qid", *[F.col(c).alias(f"{c}{k}") for c in names]) for k in (1, 0))
    diffs = good.join(bad, "qid").select(*[(F.col(f"{c}1") - F.col(f"{c}0")).alias(c) for c in names])
    both = diffs.withColumn("label", F.lit(1.0)).unionByName(diffs.select(*[(-F.col(c)).alias(c) for c in names]).withColumn("label", F.lit(0.0)))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(both)
    want = LogisticRegression(fitIntercept=False, maxIter=200, regParam=1e-3, tol=1e-12).fit(data).coefficients.toArray()
    met, total = [], learn._total
    monkeypatch.setattr(learn, "BLOCK", 16)
    monkeypatch.setattr(learn, "_total", lambda blocks, work, k: met.append(blocks.count()) or total(blocks, work, k))
    assert np.allclose(learn.fit_ranker(rows, names).weights, want, rtol=1e-5, atol=1e-7)
    assert met and max(met) < diffs.count() / 10
