import random

import numpy as np
import pytest

from quillon.llm import toxicity

BAD = ["wretchling", "scumble", "vileness"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng, docs, labels = random.Random(3), [], []
    for i in range(400):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        toxic, low = int(i % 5 == 0), int(i % 7 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(w.upper() + "!!" if low else w for w in words)))
        labels.append((i, 1 - low, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    chain = toxicity.train(docs, labels.filter("doc_id % 4 <> 1"))
    got = toxicity.score(docs.filter("doc_id % 4 = 1"), chain).join(labels, "doc_id").collect()
    assert np.mean([(r.p_toxic >= 0.5) == bool(r.toxic) for r in got]) >= 0.98
    assert np.mean([(r.p_low_quality >= 0.5) == (r.quality == 0) for r in got]) >= 0.95


def test_later_models_use_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    n = 400
    x = np.hstack([rng.random((n, 2)) < 0.5, np.zeros((n, len(toxicity.STYLE)))]).astype(float)
    first = x[:, 0]
    second = np.where(rng.random(n) < 0.95, first, 1 - first)
    chain = toxicity.Chain(toxicity.CATEGORIES, [["aaaa"], ["bbbb"]])
    chain.train(x, np.stack([first, second], axis=1), np.arange(n) % toxicity.FOLDS)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][-2] > 1  # weight of the earlier probability
    p = chain.predict(x)
    assert ((p[:, 1] > 0.5) == first).mean() == 1.0


def test_edge_cases(spark, corpus, rows):
    docs, labels = corpus
    odd = spark.createDataFrame([(None, None), (900, ""), (901, "wretchling scumble vileness " * 30_000), (902, "clean"), (902, "clean")], "doc_id long, text string")
    more = labels.union(spark.createDataFrame([(12345, 1, 1), (None, 1, 1), (0, None, 1), (0, 1, 1)], labels.schema))
    got = rows(toxicity.detect(docs.union(odd), more))
    by = {r[0]: r for r in got}
    assert len(got) == 405 and by[901][3] and not by[900][3] and not by[None][3] and not by[902][3]
    assert toxicity.detect(docs.limit(0), labels).count() == 0


def test_no_labels_or_one_class(spark, corpus):
    docs, labels = corpus
    assert not toxicity.detect(docs, labels.limit(0)).filter("toxic OR p_toxic > 0.01").count()
    assert not toxicity.detect(docs, labels.selectExpr("doc_id", "quality", "0 AS toxic")).filter("toxic").count()


def test_clashing_names(spark, corpus):
    docs, labels = corpus
    chain = toxicity.train(docs, labels)
    out = toxicity.score(docs.selectExpr("*", "'x' AS p_toxic", "'y' AS marks").limit(5), chain)
    assert out.columns == ["doc_id", "text", "marks", "p_low_quality", "p_toxic"] and out.schema["p_toxic"].dataType.typeName() == "double"


def slow_predict(chain, text):
    """The chain by loops: one string, one weight, one category at a time."""
    line, earlier = toxicity.clean(text), []
    found = [1.0 if s in line else 0.0 for s in chain.strings] + [float(np.float32(v)) for v in toxicity.style(text)]
    for columns, weights in zip(chain.columns, chain.weights):
        z = weights[-1]
        for value, w in zip([found[c] for c in columns] + earlier, weights):
            z += value * w
        earlier.append(1 / (1 + np.exp(-min(35, max(-35, z)))))
    return earlier


def test_scores_are_brute_force(spark):
    rng = np.random.default_rng(4)
    words = {0: ["calm", "river", "garden", "letter"], 1: ["vile", "scum", "hateful", "curse"]}
    texts = [" ".join(rng.choice(words[int(i % 4 == 0)] + ["the", "and"], 12)) for i in range(200)] + [None, "", "VILE  scum", "x" * 30_000 + " vile"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in toxicity.score(docs, chain).collect()}
    assert all(got[i] == pytest.approx(slow_predict(chain, text), abs=1e-6) for i, text in enumerate(texts))
    told = {r.doc_id: r.toxic for r in toxicity.detect(docs, labels).collect()}
    assert all(told[i] == (i % 4 == 0) for i in range(200)) and told[202]


def test_later_models_see_out_of_fold_probabilities():
    """Training by loops over folds gives the same weights."""
    rng = np.random.default_rng(5)
    chain = toxicity.Chain(toxicity.CATEGORIES, [["aaaa"], ["bbbb"]])
    x = np.hstack([rng.integers(0, 2, (80, 2)), rng.random((80, len(toxicity.STYLE)))]).astype(float)
    y = np.stack([(x[:, 0] + rng.random(80) > 1), (x[:, 1] + rng.random(80) > 0.9)], axis=1).astype(float)
    fold = np.arange(80) % toxicity.FOLDS
    chain.train(x, y, fold)
    first = x[:, chain.columns[0]]
    unseen = np.zeros(80)
    for row in range(80):
        w = toxicity.fit(first[fold != fold[row]], y[fold != fold[row], 0])
        unseen[row] = 1 / (1 + np.exp(-(first[row] @ w[:-1] + w[-1])))
    want = toxicity.fit(np.hstack([x[:, chain.columns[1]], unseen[:, None]]), y[:, 1])
    assert chain.weights[1] == pytest.approx(want, abs=1e-8)
