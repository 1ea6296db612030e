import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing, sharding


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            break
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        more = {s for s in rest if 2 * sizes[s] <= weight[s] * level}
        if not more:
            break
        full |= more
    return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in names}


def brute_mix(rows):
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += size(t)
    target, out = brute_targets(sizes), []
    for s in sizes:
        own = sorted(((hashlib.md5(str(i).encode()).hexdigest(), i, size(t)) for i, u, t in rows if u == s))
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        left = int(target[s]) - epochs * sizes[s]
        for _, i, n in own:
            part = max(0, min(n, left))
            left -= n
            out.append((i, n, sizes[s], target[s], epochs * n + part))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    names = ["b", "a", None, "Z", "é", "hot"]
    return [(i, rng.choice([*names, "hot", "hot", "hot"]), " ".join("w" for _ in range(rng.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_mix_is_brute_force(spark, seed):
    data = corpus(seed)
    got = {r.doc_id: r for r in mixing.mix(frame(spark, data)).collect()}
    assert len(got) == len(data)
    for i, n, total, target, taken in brute_mix(data):
        r = got[i]
        assert (r["size"], r.source_size, r.taken) == (n, total, taken) and r.target == pytest.approx(target) and taken <= 2 * n


def test_mix_reruns_agree_and_partitions_do_not_matter(spark):
    df = frame(spark, corpus(3))
    one, two = (sorted(map(tuple, mixing.mix(d).collect()), key=repr) for d in (df, df.repartition(7)))
    assert one == two


def test_mix_edge_cases(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert {(r.taken, r.target) for r in mixing.mix(frame(spark, [(1, "a", None), (2, None, " ")])).collect()} == {(0, 0.0)}
    data = [(None, "a", "x y"), (None, "a", "x y"), (1, "a", "long " * 20_000), (1, "a", "long " * 20_000), (2, "b", "z")]
    got = mixing.mix(frame(spark, data).selectExpr("*", "1 AS size", "2 AS target")).collect()
    by = Counter()
    for r in got:
        by[r.source] += r.taken
        assert r.taken <= 2 * r["size"]
    assert all(by[r.source] == int(r.target) for r in got)


def test_mixed_documents_hold_the_words_taken(spark):
    df = frame(spark, corpus(5)).withColumn("n_chars", F.length("text").cast("long"))
    want = Counter({r.doc_id: r.taken for r in mixing.mix(df).collect() if r.taken})
    out = mixing.mixed_documents(df).collect()
    got = Counter()
    for r in out:
        got[r.doc_id] += size(r.text)
        assert r.n_chars == len(r.text)
    assert +got == +want
    texts = {r.doc_id: r.text for r in df.collect()}
    assert all(texts[r.doc_id].startswith(r.text) for r in out) and sum(texts[r.doc_id] != r.text for r in out) <= 6


def test_law_of_keys(spark):
    rows = [(i, f"text {i % 50}") for i in range(2000)] + [(None, None), (None, None), (5, "text 5"), (5, "text 5")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS slot", "2 AS n")).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert all(180 < len(s) < 330 for s in slots.values()) and 150 < sum(r.grown_shard == 8 for r in got) < 300
    assert len({(r.doc_id, r.shard) for r in got}) == 2001


def test_weights(spark):
    df = spark.range(6000).withColumn("w", sharding.rendezvous(F.col("id"), {0: 1.0, 1: 2.0, 2: 3.0}))
    n = {r.w: r["count"] for r in df.groupBy("w").count().collect()}
    assert n[0] == pytest.approx(1000, rel=0.15) and n[1] == pytest.approx(2000, rel=0.1) and n[2] == pytest.approx(3000, rel=0.1)
    moved = df.filter(sharding.rendezvous(F.col("id"), {0: 1.0, 1: 2.0, 2: 3.0, 3: 2.0}) != F.col("w"))
    assert moved.filter(sharding.rendezvous(F.col("id"), {0: 1.0, 1: 2.0, 2: 3.0, 3: 2.0}) != 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        sharding.rendezvous(F.col("id"), {0: 0.0})


def test_sharding_nothing_and_hot_rows(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    hot = spark.range(900).selectExpr("IF(id % 3 = 0, 1, id + 10) AS doc_id", "'x' AS text")
    got = sharding.shard_documents(hot).filter("doc_id = 1")
    assert got.count() == 300 and got.select("slot").distinct().count() == 300


def test_rows_repeated_beyond_a_run_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    hot = spark.range(900).selectExpr("IF(id % 3 = 0, 1, id + 10) AS doc_id", "'x' AS text").repartition(3)
    by = {}
    for r in sharding.shard_documents(hot).collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == 900 and all(sorted(s) == list(range(len(s))) for s in by.values())


def brute_shards(rows, n):
    """The draw in Python: XXH64 of the key (eight bytes), seeded by 42 and then by its hash with the shard."""
    import math

    import xxhash

    def hash64(key, shard):
        h = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        return xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), h)

    return {key: max(range(n), key=lambda s: (-1 / math.log(((hash64(key, s) >> 12) + 0.5) / 2**52), s)) for key in rows}


def test_draw_is_brute_force(spark):
    keys = [*range(-50, 500), None, 2**62]
    df = spark.createDataFrame([(k, "é" * 70_000 if k == 3 else f"t{k}") for k in keys], "doc_id long, text string")
    got = sharding.shard_documents(df).collect()
    assert {r.doc_id: r.shard for r in got} == brute_shards(keys, 8) and {r.doc_id: r.grown_shard for r in got} == brute_shards(keys, 9)
    assert next(r["size"] for r in got if r.doc_id == 3) == 140_001
