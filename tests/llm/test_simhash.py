import random
import re

import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from quillon.llm import simhash
from quillon.llm.components import components


def slow_fingerprint(text, n=4):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    if not words:
        return 0
    hashes = [xxhash.xxh64(b" ".join(words[i : i + n]), seed=42).intdigest() for i in range(max(1, len(words) - n + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@given(st.text("aBÉ \t\x0b\x1c c", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_long_text_is_hashed_whole(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprint(text) == want == slow_fingerprint(text)
    assert simhash.fingerprint(text) != simhash.fingerprint(text[:6000])


def test_fingerprint_is_sparks_hash(spark):
    row = spark.sql("SELECT xxhash64('one two three four') AS h").first()
    assert simhash.fingerprint("ONE two three four") == row.h % (1 << 64)


@given(st.sets(st.integers(0, 255), max_size=40), st.integers(0, 255), st.integers(0, 4))
def test_tree_finds_all_within_radius(values, query, radius):
    tree, values = simhash.BKTree(), list(values)
    for v in values:
        tree.add(v)
    assert sorted(tree.within(query, radius)) == [i for i, v in enumerate(values) if (v ^ query).bit_count() <= radius]


@pytest.mark.parametrize(("n", "blocks"), [(0, 6), (10**6, 6), (10**9, 7), (10**11, 8)])
def test_blocks_follow_the_number_of_fingerprints(n, blocks):
    assert simhash.choose_blocks(n) == blocks


def connected(values, radius=4):
    root = {k: k for k in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in values:
        for b in values:
            if a < b and (values[a] ^ values[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in values}


@pytest.mark.parametrize(("tree", "size", "slices"), [(2048, 1 << 25, 64), (7, 3000, 64), (7, 3000, 0)])  # one broadcast, several, none
def test_links_connect_what_brute_force_does(spark, monkeypatch, tree, size, slices):
    monkeypatch.setattr(simhash, "SLICE_BYTES", size)
    monkeypatch.setattr(simhash, "SLICES", slices)
    rng = random.Random(5)
    values = {}
    for c in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            values[len(values)] = centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
    values = {min(k for k in values if values[k] == v): v for v in values.values()}
    signed = [((v - (1 << 64)) if v >> 63 else v, k) for k, v in values.items()]
    found = simhash.links(spark.createDataFrame(signed, "fp long, node long"), tree=tree).collect()
    assert all((values[r.a] ^ values[r.b]).bit_count() <= 4 for r in found)
    got = {r.node: r.component for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
    want = connected(values)
    assert {k: got.get(k, k) for k in values} == want


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(1, 2), (2, 1)], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 300)], [(9, 5), (5, 7), (1, 2), (8, 2)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    reach = {}
    for a, b in edges:
        if None not in (a, b) and a != b:
            one = reach.get(a, {a}) | reach.get(b, {b})
            reach.update(dict.fromkeys(one, one))
    assert got == {k: min(v) for k, v in reach.items()}


def test_documents(spark, docs, rows):
    long = " ".join(f"w{i}" for i in range(400))
    near = long.replace("w200 ", "w200 x ")
    texts = [long, near, "other words are in here now", None, "", "  \n", long.upper()]
    want = connected({i: slow_fingerprint(t) for i, t in enumerate(texts)})
    got = rows(simhash.near_groups(docs(*texts)))
    assert got == [(i, f"{slow_fingerprint(t):016x}", want[i]) for i, t in enumerate(texts)]
    assert want[1] == want[6] == 0 and want[4] == want[5] == 3
    kept = simhash.keep_one(docs(*texts).selectExpr("*", "1 AS component_id", "2 AS fp"))
    assert [r[0] for r in rows(kept)] == [0, 2, 3] and kept.columns[-2:] == ["component_id", "fp"]


def test_null_ids_repeats_and_nothing(spark, docs, rows):
    df = docs((None, "a b c d", None, None, None), (3, "a b c d", None, None, None), (3, "a b c d", None, None, None), (None, "unlike all of it", None, None, None))
    assert [(r[0], r[2]) for r in rows(simhash.near_groups(df))] == [(3, 3), (3, 3), (None, 3), (None, None)]
    assert simhash.keep_one(df).count() == 4
    assert simhash.near_groups(docs().limit(0)).count() == 0
