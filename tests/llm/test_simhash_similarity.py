import random

import numpy as np

import corpus_pipeline
from quillon.llm import simhash, simhash_similarity


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Ids kept, by all pairs."""
    s, root = [sets(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [i for i in range(len(s)) if find(i) == i]


def test_any_edit_of_one_word_and_similarities_around_the_bound(spark, docs):
    rng, texts = random.Random(4), [None, "", "a b c", "A  b c", "a b d"]
    for c in range(12):
        base = [f"w{c}x{i}" for i in range(80)]
        texts.append(" ".join(base))
        for edits in (1, 1, 1, 2, 3, 4):
            other = list(base)
            for at in rng.sample(range(80), edits):
                other[at] = f"new{at}"
            texts.append(" ".join(other))
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    got = sorted(r.doc_id for r in stage(spark, docs(*texts), "").select("doc_id").collect())
    want = brute(texts)
    assert got == want and len(want) < len(texts) - 36


def test_null_ids_and_nothing(spark, docs):
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    df = docs((None, "a b", None, None, None), (1, "a b", None, None, None), (2, "a b", None, None, None))
    assert sorted((r.doc_id for r in stage(spark, df, "").collect()), key=str) == [1, None]
    assert stage(spark, df.limit(0), "").count() == 0


def test_a_group_whose_members_mostly_do_not_link(spark, docs, monkeypatch):
    """Edits of one text that are near each other: some link through a chain, some with none; also with shards cut into trees."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(60):
        other = list(base)
        for at in rng.sample(range(200), 1 + k % 9):
            other[at] = f"x{k}y{at}"
        texts.append(" ".join(other))
    for tree in (2048, 16):
        monkeypatch.setattr(simhash_similarity, "TREE", tree)
        got = sorted(r.doc_id for r in simhash.keep_one(docs(*texts)).select("doc_id").collect())
        assert got == brute(texts) and 1 < len(got) < 50


def test_candidates_of_a_group_do_not_grow_with_its_square(spark, docs, monkeypatch):
    """Near texts that do not link are not all joined with each other; no link is lost."""
    rng, tried, confirmed = random.Random(8), [], simhash_similarity._confirmed
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(120):
        other = list(base)
        for at in rng.sample(range(150), 1 + k % 5):
            other[at] = f"x{k}y{at}"
        texts.append(" ".join(other))

    def counted(sets, pairs, similarity):
        tried.append(pairs.count())
        return confirmed(sets, pairs, similarity)

    monkeypatch.setattr(simhash_similarity, "_confirmed", counted)
    got = sorted(r.doc_id for r in simhash.keep_one(docs(*texts)).select("doc_id").collect())
    assert got == brute(texts) and 20 < len(got) < 100
    assert sum(tried) < 6 * len(texts)


def test_a_sketch_never_hides_a_link():
    rng = random.Random(9)
    for size in (1, 4, 80, 5000, 70000):
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], dtype="uint64"))
        b = np.unique(np.concatenate([a[: size - size // 10], np.array([rng.getrandbits(64) for _ in range(size // 10)], dtype="uint64")]))
        cells = [np.frombuffer(simhash_similarity.sketch(x), dtype="uint8") for x in (a, b)]
        n = np.array([len(a), len(b)])
        assert simhash_similarity._can_link(cells, n, 0, np.array([1]), 0.8).all()
