"""Near-deduplication of embeddings by NN-descent.

Equal vectors become one node with a weight.  A first neighbour graph comes from
random hyperplanes: for each of ``TREES`` sets, vectors are sorted by the code of
their signs (and one more projection) and every run of ``LEAF`` vectors is compared
in itself.  NN-descent rounds then compare, around each node, its neighbours and
those whose neighbour it is with each other, where at least one of the two is new to
its list, and keep each node's best.  A list has ``K`` places; one whose entries are all
links is saturated, as there may be more: its places are doubled, links of the first
graph that had no place move in, and its node is searched again, up to ``MOST`` places, beyond which only links are kept.  Rounds go on until one
finds no link and saturates no list.  Links are the pairs with a cosine of at least
``threshold`` (double precision); they connect components
(:mod:`quillon.llm.components`).  Where lists of ``MOST`` places are still saturated, their
components are searched against each other exactly (:func:`merge`); and all links inside a
component are counted exactly, block by block, so that ``n_links`` counts every link, however
dense.  An audit compares a bounded set of queries with all vectors; while its recall is below
``RECALL``, another set of hyperplanes and further rounds follow, and if that does not help,
all components, single vectors too, are searched against each other exactly.

Scale.  The tables that shuffle are slim lists and copies of vectors: a centre is sent its
neighbours only in rounds in which one of them is new.  Runs are cut by range partitioning,
so a code that a third of all vectors share is spread over tasks.  Reverse lists take the
first by a hash, new ones before others (NN-descent's sampling); what that misses the exact
pass finds.  Inside a component blocks meet in pairs, and counts leave a block, not pairs;
blocks are as large as ``BLOCK_BYTES`` of vectors allow, so that a vector is copied once per
such block of its component (a smaller component makes up to ``SPLIT`` blocks, to use more than
one task).  Exact counts in a component of m vectors compare m * m / 2 pairs whatever is done.
Between components two blocks meet only where the angle of their centres, less their radii,
allows a link (tested for tiles of ``TILE`` centres), and one link of two blocks leaves.  The
exact search of all components grows with the square of their number.

Cases.  A vector that is null, empty or zero, or holds a null or non-finite component,
links with nothing, and so does one whose id is null; these count 0 links, are a
component of their own, and are kept.  Vectors of different length do not link.
Repeated rows are further equal vectors; rows that repeat an id count as vectors of
their own.  Of entries with equal cosine the smaller id comes first in a list, which decides
what is searched but not what links: a pair at the threshold links.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.storage import discard, stash

THRESHOLD, K, MOST, TREES, LEAF, TILE = 0.95, 10, 40, 8, 256, 4096
#: Bytes of a block's vectors in double precision; least vectors and most blocks where bytes don't ask for more; rows of a product.
BLOCK_BYTES, BLOCK, SPLIT, STRIP = 16 << 20, 128, 16, 1024
#: Recall wanted; most queries of the audit; most repeats.
RECALL, QUERIES, REPEATS = 0.98, 500, 3


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planes(dim: int, seed: int, bits: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits + 1))


def _runs(*keys: np.ndarray) -> list[int]:
    """Starts of runs of equal keys, and the end."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return [0, *np.flatnonzero(new).tolist(), n]


def _whole(key: str, work):
    """``work`` over sorted rows, in frames that hold every value of ``key`` whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            last = _runs(batch[key].to_numpy())[-2]
            if last or held and held[-1][key].iat[-1] != batch[key].iat[0]:
                yield from work(pd.concat([*held, batch.iloc[:last]], ignore_index=True))
                held = [batch.iloc[last:]]
            else:
                held.append(batch)
        if held:
            yield from work(pd.concat(held, ignore_index=True))

    return run


def _each(keys: tuple[str, ...], unit):
    """``unit`` over each run of equal keys of sorted rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            cuts = _runs(*(batch[c].to_numpy() for c in keys))
            if held and any(held[-1][c].iat[-1] != batch[c].iat[0] for c in keys):
                yield from unit(pd.concat(held, ignore_index=True))
                held = []
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                yield from unit(pd.concat([*held, batch.iloc[a:b]], ignore_index=True) if held else batch.iloc[a:b])
                held = []
            held.append(batch.iloc[cuts[-2] :])
        if held:
            yield from unit(pd.concat(held, ignore_index=True))

    return run


def _file(seeds: list[int], bits: int):
    """Copies of each node under the codes of several sets of hyperplanes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby(batch["vec"].map(len)):
                x = _unit(some["vec"].to_numpy())
                for seed in seeds:
                    p = x @ _planes(dim, seed, bits)
                    code = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), dtype=np.int64)
                    yield pd.DataFrame({"tree": seed, "dim": dim, "code": code, "p": p[:, bits], "node": some["node"].to_numpy(), "vec": some["vec"].to_numpy()})

    return run


def _best(k: int, most: int, threshold: float):
    """Each vector's ``k`` nearest in its run of ``LEAF`` rows, and links up to ``most``."""

    def leaf(part: pd.DataFrame) -> pd.DataFrame:
        x, nodes = _unit(part["vec"].to_numpy()), part["node"].to_numpy()
        s = x @ x.T
        np.fill_diagonal(s, -2.0)
        m = min(most, len(x) - 1)
        at = np.argpartition(-s, m - 1, axis=1)[:, :m]
        sim = np.take_along_axis(s, at, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        at, sim = np.take_along_axis(at, order, 1), np.take_along_axis(sim, order, 1)
        i, j = np.nonzero((np.arange(m) < k) | (sim >= threshold))
        return pd.DataFrame({"a": nodes[i], "b": nodes[at[i, j]], "sim": sim[i, j]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            cuts = _runs(batch["tree"].to_numpy(), batch["dim"].to_numpy())
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                yield from (leaf(batch.iloc[i : min(i + LEAF, b)]) for i in range(a, b, LEAF) if min(i + LEAF, b) - i > 1)
            a, b = cuts[-2:]
            done = a + max(0, (b - a) // LEAF - 1) * LEAF  # the last run waits, so that it is not a short one
            yield from (leaf(batch.iloc[i : i + LEAF]) for i in range(a, done, LEAF))
            rest = batch.iloc[done:]
        if rest is not None:
            yield from (leaf(rest.iloc[i : i + LEAF]) for i in range(0, len(rest), LEAF) if len(rest) - i > 1)

    return run


def _local_join(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pairs around some whole centres that improve a list, at least one of the two new there: (a, b, sim) out."""
    x, nodes, least, new = _unit(part["vec"].to_numpy()), part["node"].to_numpy(), part["least"].to_numpy(), part["new"].to_numpy()
    out = []
    cuts = _runs(part["centre"].to_numpy())
    for a, b in zip(cuts, cuts[1:]):
        if b - a > 1:
            s = x[a:b] @ x[a:b].T
            np.fill_diagonal(s, -2.0)
            s[np.ix_(~new[a:b], ~new[a:b])] = -2.0
            i, j = np.nonzero(s > least[a:b, None])
            out.append((nodes[a + i], nodes[a + j], s[i, j]))
    if out:
        found = pd.DataFrame({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out]), "sim": np.concatenate([o[2] for o in out])})
        yield found.drop_duplicates(["a", "b"])


def _keep(pairs: DataFrame, k: int, most: int, threshold: float) -> DataFrame:
    """Lists (a, b, sim, new, cap) of the best of ``pairs`` (the same, cap null for candidates); saturated lists double their places.

    ``new`` are entries that were no entries before, and all of a list that has just been enlarged.
    """
    best = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"), F.max("cap").alias("cap"))
    mine = W.partitionBy("a")
    ranked = best.withColumn("cap", F.coalesce(F.max("cap").over(mine), F.lit(k))).withColumn("r", F.row_number().over(mine.orderBy(F.desc("sim"), "b")))
    kept = ranked.filter((F.col("r") <= F.col("cap")) & ((F.col("r") <= k) | (F.col("sim") >= threshold)))
    full = (F.count(F.lit(1)).over(mine) == F.col("cap")) & (F.min("sim").over(mine) >= threshold) & (F.col("cap") < most)
    kept = kept.withColumn("full", full)
    return kept.select("a", "b", "sim", (F.col("new") | F.col("full")).alias("new"), F.when(F.col("full"), F.least(F.col("cap") * 2, F.lit(most))).otherwise(F.col("cap")).alias("cap"), "full")


def seed_graph(nodes: DataFrame, n: int, seeds: list[int], k: int, most: int, threshold: float) -> DataFrame:
    """Pairs (a, b, sim) that meet in a run: for each node its nearest, and links beyond those."""
    bits = max(0, ceil(log2(max(1, n / LEAF))))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = nodes.schema["vec"].dataType.simpleString()
    filed = nodes.select("node", "vec").mapInPandas(_file(seeds, bits), f"tree int, dim int, code long, p double, node long, vec {kind}")
    runs = filed.repartitionByRange(parts, "tree", "dim", "code", "p").sortWithinPartitions("tree", "dim", "code", "p", "node")
    return runs.mapInPandas(_best(k, most, threshold), "a long, b long, sim double")


def _candidates(pairs: DataFrame) -> DataFrame:
    """(a, b, sim) as entries that no list has yet."""
    return pairs.select("a", "b", "sim", F.lit(True).alias("new"), F.lit(None).cast("int").alias("cap"))


def descend(graph: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """One NN-descent round: pairs that are better than the worst entry of a list, and all entries seen from their other end."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    caps = graph.groupBy("a").agg(F.max("cap").alias("cap"), F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
    draw = F.row_number().over(W.partitionBy("b").orderBy(F.desc("new"), F.xxhash64("a"), "a"))
    back = graph.select("a", "b", "new").withColumn("r", draw).join(caps.select(F.col("a").alias("b"), F.col("cap").alias("room")), "b", "left")
    back = back.filter(F.col("r") <= F.coalesce("room", F.lit(k))).select(F.col("b").alias("centre"), F.col("a").alias("node"), "new")
    around = graph.select(F.col("a").alias("centre"), F.col("b").alias("node"), "new").unionByName(back)
    around = around.groupBy("centre", "node").agg(F.max("new").alias("new"))
    around = around.withColumn("any", F.max("new").over(W.partitionBy("centre"))).filter("any").drop("any")
    free = F.when(F.col("cap") > k, threshold - 1e-9).otherwise(-1.5)  # enlarged lists take links only
    held = nodes.select("node", "vec").join(caps.select(F.col("a").alias("node"), F.when(F.col("n") < F.col("cap"), free).otherwise(F.col("low")).alias("least")), "node", "left")
    held = held.withColumn("least", F.coalesce("least", F.lit(-1.5)))
    rows = around.join(held.repartition(parts), "node").repartition(parts, "centre").sortWithinPartitions("centre", "node")
    met = rows.select("centre", "node", "least", "new", "vec").mapInPandas(_whole("centre", _local_join), "a long, b long, sim double")
    return met.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def _blocks(rows: DataFrame, by: str = "component") -> DataFrame:
    """Add ``parts``, the blocks that ``by`` is cut into, and ``c``, the block of the row."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, size = F.count(F.lit(1)), F.max(F.size("vec")) * 8
    cuts = F.greatest(F.ceil(n * size / BLOCK_BYTES), F.least(F.lit(SPLIT), F.ceil(n / BLOCK))).cast("int")
    return rows.join(rows.groupBy(by).agg(cuts.alias("parts")).repartition(parts), by).withColumn("c", F.pmod(F.hash("node"), "parts"))


def _count(threshold: float):
    """Weighted links of every node of a unit (two blocks of a component, or one with itself) to the other block."""

    def unit(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x, w, nodes = _unit(part["vec"].to_numpy()), part["weight"].to_numpy(), part["node"].to_numpy()
        one = (part["c"] == part["i"]).to_numpy()
        same = part["i"].iat[0] == part["j"].iat[0]
        p, q = np.flatnonzero(one), np.flatnonzero(one if same else ~one)
        links, partners = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        for a in range(0, len(p), STRIP):
            some = p[a : a + STRIP]
            hit = x[some] @ x[q].T >= threshold
            if same:
                hit[np.arange(len(some)), np.arange(a, a + len(some))] = False
            links[some] += hit @ w[q]
            partners[some] += hit.sum(axis=1)
            if not same:
                links[q] += w[some] @ hit
                partners[q] += hit.sum(axis=0)
        yield pd.DataFrame({"node": nodes, "links": links, "partners": partners})

    return unit


def count_links(nodes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """``node``, ``component``, ``links`` (by weight) and ``partners`` (nodes), for the nodes of ``found``: all links inside components."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _blocks(nodes.join(found, "node"))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("c", o).alias("i"), F.greatest("c", o).alias("j")))
    units = rows.select("component", "node", "vec", "weight", "c", F.explode(pair).alias("u")).select("component", "node", "vec", "weight", "c", "u.i", "u.j")
    units = units.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    counts = units.mapInPandas(_each(("component", "i", "j"), _count(threshold)), "node long, links long, partners long")
    counts = counts.groupBy("node").agg(F.sum("links").alias("links"), F.sum("partners").alias("partners"))
    return stash(found.join(counts, "node"))


def _ball(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A block's centre and the largest angle to it."""
    x = _unit(part["vec"].to_numpy())
    mean = x.sum(axis=0)
    centre = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-9 else x[0]
    radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max()) if len(x) > 1 else 0.0
    yield pd.DataFrame({"component": part["component"].iat[0], "c": part["c"].iat[0], "dim": len(centre), "centre": [centre], "radius": radius})


def _close(threshold: float):
    """Blocks of two components that a link may join, from two tiles of centres."""

    def unit(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        one, same = (part["tile"] == part["i"]).to_numpy(), part["i"].iat[0] == part["j"].iat[0]
        p, q = part[one], part if same else part[~one]
        if len(p) and len(q):
            y, far = np.stack(q["centre"].to_numpy()), q["radius"].to_numpy() + np.arccos(threshold) + 1e-6
            other = q["component"].to_numpy()
            for at in range(0, len(p), STRIP):
                some = p.iloc[at : at + STRIP]
                mine = some["component"].to_numpy()[:, None]
                near = np.stack(some["centre"].to_numpy()) @ y.T >= np.cos(np.minimum(some["radius"].to_numpy()[:, None] + far, np.pi)) - 1e-9
                m, n = np.nonzero(near & ((mine < other) if same else (mine != other)))
                ends = {"component": (some, m), "c": (some, m), "component2": (q, n), "c2": (q, n)}
                yield pd.DataFrame({name: frame[name.rstrip("2")].to_numpy()[rows] for name, (frame, rows) in ends.items()})

    return unit


def _one_link(threshold: float):
    def unit(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x, one = _unit(part["vec"].to_numpy()), (part["side"] == 0).to_numpy()
        p, q = x[one], x[~one]
        if any((p[a : a + STRIP] @ q.T).max(initial=-2.0) >= threshold for a in range(0, len(p), STRIP)):
            yield part[["component", "component2"]].head(1)

    return unit


def merge(nodes: DataFrame, found: DataFrame, threshold: float, only: DataFrame | None = None) -> DataFrame:
    """``found`` (node, component) after an exact search for links between its components, or between those of ``only``."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    searched = found if only is None else found.join(only, "component", "left_semi")
    rows = stash(_blocks(nodes.select("node", "vec").join(searched, "node")).select("component", "c", "vec"))
    sorted_rows = rows.repartition(parts, "component", "c").sortWithinPartitions("component", "c")
    balls = stash(sorted_rows.mapInPandas(_each(("component", "c"), _ball), "component long, c int, dim int, centre array<double>, radius double"))
    tiles = max(1, ceil(balls.count() / TILE))
    pair = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda o: F.struct(F.least("tile", o).alias("i"), F.greatest("tile", o).alias("j")))
    dealt = balls.withColumn("tile", F.pmod(F.hash("component", "c"), F.lit(tiles))).withColumn("u", F.explode(pair)).select("*", "u.i", "u.j").drop("u")
    dealt = dealt.repartition(parts, "dim", "i", "j").sortWithinPartitions("dim", "i", "j")
    met = stash(dealt.mapInPandas(_each(("dim", "i", "j"), _close(threshold)), "component long, c int, component2 long, c2 int"))
    far = rows.withColumnsRenamed({"component": "component2", "c": "c2"})
    both = rows.join(met, ["component", "c"]).withColumn("side", F.lit(0)).unionByName(far.join(met, ["component2", "c2"]).withColumn("side", F.lit(1)))
    unit = ["component", "c", "component2", "c2"]
    both = both.repartition(parts, *unit).sortWithinPartitions(*unit)
    joined = components(both.mapInPandas(_each(tuple(unit), _one_link(threshold)), "component long, component2 long"), "component", "component2")
    joined = stash(joined.select(F.col("node").alias("component"), F.col("component").alias("into")))
    out = stash(found.join(joined, "component", "left").select("node", F.coalesce("into", "component").alias("component")))
    discard(rows, balls, met, joined)
    return out


def audit(nodes: DataFrame, links: DataFrame, n: int, threshold: float, many: int = MOST) -> float:
    """Share of a node's true partners that ``links`` (node, links) counts, for at most about ``QUERIES`` nodes.

    Equal vectors count once.  The lesser of two means over queries: those with fewer than ``many`` partners, and the others.
    """
    draw = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 20)) < ceil((1 << 20) * min(1.0, QUERIES / max(1, n)))
    asked = [(r["node"], r["vec"]) for r in nodes.filter(draw).select("node", "vec").limit(2 * QUERIES).collect()]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = dict.fromkeys((node for node, _ in asked), 0)
        for batch in batches:
            for dim, some in batch.groupby(batch["vec"].map(len)):
                mine = [(node, vec) for node, vec in asked if len(vec) == dim]
                if mine:
                    hit = _unit([v for _, v in mine]) @ _unit(some["vec"].to_numpy()).T >= threshold
                    hit &= np.array([node for node, _ in mine])[:, None] != some["node"].to_numpy()
                    for (node, _), k in zip(mine, hit.sum(axis=1)):
                        total[node] += int(k)
        yield pd.DataFrame([(k, v) for k, v in total.items() if v], columns=["node", "truth"], dtype="int64")

    true = nodes.mapInPandas(compare, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
    share = true.join(links, "node", "left").groupBy(F.col("truth") < many).agg(F.avg(F.coalesce("links", F.lit(0)) / F.col("truth")).alias("share"))
    return min((r["share"] for r in share.collect()), default=1.0)


def search(nodes: DataFrame, n: int, graph: DataFrame | None, seeds: list[int], threshold: float, k: int, most: int) -> DataFrame:
    """Lists of neighbours after fresh hyperplanes ``seeds`` and as many rounds as find links or enlarge lists."""
    fresh = stash(seed_graph(nodes, n, seeds, k, most, threshold).groupBy("a", "b").agg(F.max("sim").alias("sim")))
    reserve = _candidates(fresh.filter(F.col("sim") >= threshold))  # links that lists had no place for
    lists = _candidates(fresh) if graph is None else _candidates(fresh).unionByName(graph.drop("full"))
    graph = stash(_keep(lists, k, most, threshold))
    full = graph.filter("full").limit(1).count()
    while True:
        pairs = _candidates(descend(graph, nodes, k, threshold)).unionByName(graph.select("a", "b", "sim", F.lit(False).alias("new"), "cap"))
        better = stash(_keep(pairs.unionByName(reserve) if full else pairs, k, most, threshold))
        discard(graph)
        graph = better
        links, full = graph.agg(F.count_if(F.col("new") & ~F.col("full") & (F.col("sim") >= threshold)), F.count_if("full")).first()
        if not links and not full:
            discard(fresh)
            return graph


def near_groups(vectors: DataFrame, id: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD, k: int = K, most: int = MOST) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept."""
    rows = stash(vectors.select(F.col(id), F.when(usable(F.col(vec)) & F.col(id).isNotNull(), F.col(vec)).alias("vec")))
    classes = rows.filter("vec IS NOT NULL").groupBy("vec").agg(F.min(id).cast("long").alias("node"), F.count(F.lit(1)).alias("weight"))
    nodes = stash(classes)
    n = nodes.count()
    slim = nodes.select("node", "vec", "weight")
    graph = None
    for again in range(REPEATS):
        graph = search(slim, n, graph, list(range(again * TREES, (again + 1) * TREES)), threshold, k, most)
        found = stash(components(graph.filter(F.col("sim") >= threshold)))
        full = graph.groupBy(F.col("a").alias("node")).agg(F.count_if(F.col("sim") >= threshold).alias("n")).filter(F.col("n") >= most)
        saturated = stash(found.join(full, "node").select("component").distinct())
        if not saturated.isEmpty():
            found = merge(slim, found, threshold, saturated)
        links = count_links(slim, found, threshold)
        discard(saturated)
        if audit(slim, links.select("node", F.col("partners").alias("links")), n, threshold, most) >= RECALL:
            break
    else:
        alone = slim.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
        links = count_links(slim, merge(slim, found.unionByName(alone), threshold), threshold)
    named = stash(
        nodes.join(links, "node", "left").select(
            F.col("vec").alias("key"), F.coalesce("component", "node").alias("component"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n")
        )
    )
    discard(graph, found, links, nodes)
    out = rows.withColumnRenamed("vec", "key").join(named, "key", "left")
    component = F.coalesce("component", F.col(id))
    return out.select(
        id, F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col(id).eqNullSafe(component).alias("kept")
    )
