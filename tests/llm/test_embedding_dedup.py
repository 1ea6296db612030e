import numpy as np
import pytest

from quillon.llm import embedding_dedup as e


def brute(vectors, threshold=0.95):
    """Links and components by all pairs; ids are places."""
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.float32(vectors[i]).astype(float), np.float32(vectors[j]).astype(float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return sorted([(i, links[i], find(i), find(i) == i) for i in range(n)], key=repr)


def frame(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")


def test_clusters_and_noise(spark, rows):
    rng = np.random.default_rng(1)
    vectors = list(rng.standard_normal((300, 16)))
    for c in range(6):
        centre = rng.standard_normal(16)
        vectors += [centre + rng.standard_normal(16) * 0.1 for _ in range(5 * c + 2)]
    vectors = [list(map(float, v)) for v in vectors] + [list(map(float, vectors[0]))] * 9
    assert rows(e.near_groups(frame(spark, vectors))) == brute(vectors)


def test_saturated_lists_are_enlarged(spark, rows, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 16)  # blocks meet in pairs
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(8)
    vectors = [list(map(float, centre + rng.standard_normal(8) * 0.05)) for _ in range(80)]
    got = rows(e.near_groups(frame(spark, vectors), k=4))
    assert got == brute(vectors) and got[0][1] > 40


def test_edge_cases(spark, rows):
    big = [3e38, 3e38]
    vectors = [None, [], [0.0, 0.0], [1.0, float("nan")], [float("inf"), 1.0], [1.0, None], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1.0, 0.0, 0.0], big, [1e-38, 1e-38], [-0.0, 5.0], [0.0, 5.0]]
    assert rows(e.near_groups(frame(spark, vectors))) == brute(vectors)
    assert e.near_groups(frame(spark, [])).count() == 0


def test_null_and_repeated_ids(spark, rows):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>").selectExpr("*", "1 AS n_links", "2 AS node")
    assert rows(e.near_groups(df)) == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, True)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_vectors(spark, rows, n):
    vectors = [[1.0, float(i)] for i in range(n)]
    assert rows(e.near_groups(frame(spark, vectors))) == brute(vectors)


def test_audit_sees_what_is_missing(spark):
    vectors = [[1.0, 0.001 * i] for i in range(20)]
    nodes = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "node long, vec array<double>, weight long")
    half = spark.createDataFrame([(i, 0, 19 if i % 2 else 0) for i in range(20)], "node long, component long, links long")
    assert e.audit(nodes, half, 20, 0.95) == 0.5


def blobs(sizes, dim=64, across=0.965, within=0.995):
    """Two dense groups whose vectors link across, but have more than K nearer ones in their own."""
    rng = np.random.default_rng(7)
    axes = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    turn = np.arccos(across) / 2
    out = []
    for side, size in zip((1, -1), sizes):
        centre = np.cos(turn) * axes[0] + side * np.sin(turn) * axes[1]
        for _ in range(size):
            away = axes[2:].T @ rng.standard_normal(dim - 2)
            out.append(centre + away / np.linalg.norm(away) * np.sqrt(1 - within))
    return [list(map(float, v)) for v in out]


@pytest.mark.parametrize("sizes", [(12, 12), (40, 25), (90, 60)])
def test_dense_groups_that_link_across(spark, rows, monkeypatch, sizes):
    monkeypatch.setattr(e, "BLOCK", 16)
    monkeypatch.setattr(e, "TILE", 2)
    vectors = blobs(sizes)
    got = rows(e.near_groups(frame(spark, vectors)))
    assert got == brute(vectors) and got[0][1] >= sizes[0] - 1 + sizes[1] // 2 and sum(r[3] for r in got) == 1


def test_exact_search_when_the_audit_fails(spark, rows, monkeypatch):
    rng = np.random.default_rng(3)
    pairs = rng.standard_normal((60, 16))
    vectors = [list(map(float, v)) for v in np.concatenate([pairs, pairs + 0.02 * rng.standard_normal((60, 16))])]
    monkeypatch.setattr(e, "seed_graph", lambda nodes, *_: nodes.sparkSession.createDataFrame([(0, 1, 0.0)], "a long, b long, sim double"))
    assert rows(e.near_groups(frame(spark, vectors))) == brute(vectors)


def test_audit_does_not_drown_pairs_in_a_large_group(spark):
    group = [[1.0, 0.0001 * i, 0.0] for i in range(90)]
    pair = [[0.0, 0.001 * i, 1.0] for i in range(2)]
    nodes = spark.createDataFrame([(i, v, 1) for i, v in enumerate(group + pair)], "node long, vec array<double>, weight long")
    links = spark.createDataFrame([(i, 0, 89) for i in range(90)], "node long, component long, links long")
    assert e.audit(nodes, links, 92, 0.95) == 0.0


def test_bundles_among_others_and_small_memory(spark, rows, monkeypatch):
    monkeypatch.setattr(e, "BLOCK_BYTES", 64 * 8 * 7)  # blocks of seven vectors
    monkeypatch.setattr(e, "STRIP", 3)
    others = [list(map(float, v)) for v in np.random.default_rng(8).standard_normal((140, 64))]
    vectors = blobs((30, 30)) + others
    got = rows(e.near_groups(frame(spark, vectors)))
    assert got == brute(vectors) and got[0][1] == 59


def test_places_double_until_a_list_ends_without_a_link(spark, rows, monkeypatch):
    """No exact search between components is needed where ``MOST`` places suffice."""
    monkeypatch.setattr(e, "merge", lambda *a: pytest.fail("lists were long enough"))
    vectors = blobs((14, 12)) + [list(map(float, v)) for v in np.random.default_rng(9).standard_normal((60, 64))]
    assert rows(e.near_groups(frame(spark, vectors), k=4, most=32)) == brute(vectors)
