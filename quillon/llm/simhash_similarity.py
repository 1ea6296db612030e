"""SimHash near-deduplication for a similarity of shingle sets.

Documents link where their sets of word shingles have a Jaccard similarity of at least
``similarity``.  Equal sets are one node.  A node's fingerprint is the SimHash of its set, of
``BITS`` bits; its shards are ``BANDS`` keys of ``ROWS`` minimum hashes each, as ranges of bits
cannot serve a radius this wide.  In a shard a BK-tree holds the fingerprints, a lookup
follows only edges within the radius, and what it finds is confirmed by the exact similarity.
That goes in rounds, nearest first: each node tries the few nearest that all its lookups
find in other components, then some more behind them, at last all that are left (``ROUNDS``),
so that pairs inside a group are not written out.  From the second round on, pairs whose
sketches (counts of a set's hashes by cell) prove that they cannot link are left out.  A node that has nothing left in another
component is settled: it has tried every near node that was not of its component, and leaves
its shards.  Rounds end when all are settled, or none has a node of another component in a shard.

What can be missed: a pair at 0.8 shares no shard with a chance of about one in seven million,
and its fingerprints differ in more than the radius (five standard deviations above the mean
for sets of equal size) with one of about one in a million, for sets of four and five shingles
about one in a thousand.

Scale.  Twenty-four bytes and the fingerprint shuffle for each band.  A shard beyond ``TREE``
nodes is cut into trees that meet in pairs.  Nodes of one shard that are near but do not
link cost distances and sketch bounds with the square of their number; only pairs that the
bound allows are joined.

Cases.  Texts without words are equal; a text of fewer words is one shingle.  Documents
without an id have no component.  Repeated rows are one node.  Long texts are read whole, in
pieces of bounded size.  A pair at the threshold links.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import acos, ceil, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.simhash import SEED, TREE, BKTree, _runs_of, shingle_spans
from quillon.llm.workers import small_batches
from quillon.storage import discard, stash

BITS, BANDS, ROWS, PIECE, STRIP = 256, 40, 5, 2048, 128
#: Candidates that a node tries in each round; the last one takes all that are left.
ROUNDS = (2, 2, 16, 1 << 40)
#: A distance beyond all others; fingerprints that walk a tree together.
FAR, PART = 1 << 14, 512
#: Cells of a sketch, by the highest byte of a hash.
CELLS = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def radius_of(similarity: float) -> int:
    """Bits that fingerprints of sets that similar may differ in: five standard deviations beyond the mean."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return ceil(BITS * p + 5 * sqrt(BITS * p * (1 - p)))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the set of shingles (A-Z lower-cased, split at ASCII white space)."""
    line, spans = shingle_spans(text, words)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64))


def whole(some: np.ndarray) -> int:
    """The node of a set."""
    return xxhash.xxh64_intdigest(some.tobytes(), SEED)


def fingerprint(some: np.ndarray) -> bytes:
    """The SimHash of a set of hashes, as little-endian bytes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(some), PIECE):
        x = some[at : at + PIECE, None] * (_MIX + np.arange(0, 2 * (BITS // 64), 2, dtype=np.uint64))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(some), bitorder="little").tobytes()


def sketch(some: np.ndarray) -> bytes:
    """How many hashes of a set each of ``CELLS`` cells has; nothing for a set too large for bytes."""
    cells = np.bincount((some >> np.uint64(56)).astype(np.int64), minlength=CELLS)
    return cells.astype(np.uint8).tobytes() if cells.max(initial=0) < 256 else b""


def _can_link(cells: list[np.ndarray], n: np.ndarray, a: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Which of ``others`` may be similar enough to ``a``: a bound from the sketches, as no more hashes are shared than each cell allows."""
    out = np.array([len(cells[o]) == 0 or len(cells[a]) == 0 for o in others.tolist()], dtype=bool)
    if not out.all():
        some = others[~out]
        shared = np.minimum(np.stack([cells[o] for o in some.tolist()]), cells[a]).sum(axis=1, dtype=np.int64)
        out[~out] = shared >= similarity * (n[a] + n[some] - shared) - 1e-9
    return out


@cache
def _draws() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the minimum hashes."""
    a, b = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
    return a | np.uint64(1), b


def keys(some: np.ndarray) -> np.ndarray:
    """A key for each band, as signed longs."""
    a, b = _draws()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(some), STRIP):  # a strip of products stays in a core's cache
        products = some[at : at + STRIP, None] * a
        products += b
        np.minimum(least, products.min(axis=0), out=least)
    key = np.zeros(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * _MIX
    return key.view(np.int64)


def _sets(docs: DataFrame, marked: DataFrame, wanted: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """``node`` and its shingles, for the nodes of ``wanted``; one document of each node is read again."""

    @F.pandas_udf("node long, shingles array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, words) for t in texts]
        return pd.DataFrame({"node": np.array([whole(s) for s in sets], dtype=np.uint64).view(np.int64), "shingles": [s.view(np.int64) for s in sets]})

    ids = marked.join(wanted.select("node").distinct(), "node").groupBy("node").agg(F.min("id").alias("__id")).select("__id").distinct()
    sets = docs.join(ids, docs[id] == F.col("__id")).select(of(F.col(text)).alias("s")).select("s.*").dropDuplicates(["node"])
    return stash(sets)


def _confirmed(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    one, two = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    met = pairs.join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return stash(met.filter(F.col("both") >= similarity * (F.size("sa") + F.size("sb") - F.col("both")) - 1e-9).select("a", "b"))


def _distances(tree: BKTree, words: np.ndarray, asked: np.ndarray, radius: int) -> np.ndarray:
    """Distances of the fingerprints ``asked`` to the places of a tree (``words``), ``FAR`` beyond the radius; all walk the tree together."""
    out = np.full((len(asked), len(words)), FAR, dtype=np.int16)
    todo = [(0, np.arange(len(asked)))] if len(words) else []
    while todo:
        at, rows = todo.pop()
        d = np.bitwise_count(asked[rows] ^ words[at]).sum(axis=1, dtype=np.int16)
        near = d <= radius
        out[rows[near], at] = d[near]
        for edge, below in tree.children[at].items():
            some = rows[np.abs(d - edge) <= radius]
            if len(some):
                todo.append((below, some))
    return out


def _nearest(group: pd.DataFrame, one: np.ndarray, asking: np.ndarray, radius: int, similarity: float, most: int) -> Iterator[tuple]:
    """(node, near, d) of the rows ``asking`` in the tree of the rows ``one``; see :func:`_look_up`."""
    node, n, d0, past = (group[c].to_numpy() for c in ("node", "n", "past_d", "past_near"))
    kind = group["component"].to_numpy()
    words = np.frombuffer(b"".join(group["fp"]), dtype="<u8").reshape(len(group), -1)
    cells = [np.frombuffer(c, dtype=np.uint8) for c in group["sketch"]] if "sketch" in group else None
    tree = BKTree()
    for place in one.tolist():
        tree.add(int.from_bytes(group["fp"].iat[place], "little"))
    for start in range(0, len(asking), PART):
        q = asking[start : start + PART]
        d = _distances(tree, words[one], words[q], radius)
        small, large = np.minimum(n[q, None], n[one]), np.maximum(n[q, None], n[one])
        behind = (d > d0[q, None]) | (d == d0[q, None]) & (node[one] > past[q, None])
        d[~behind | (kind[q, None] == kind[one]) | (small < similarity * large - 1e-9)] = FAR
        if cells is not None:
            for i, a in enumerate(q.tolist()):
                at = np.flatnonzero(d[i] < FAR)
                d[i, at[~_can_link(cells, n, a, one[at], similarity)]] = FAR
        last = np.partition(d, most - 1, axis=1)[:, most - 1, None] if most < d.shape[1] else FAR
        i, j = np.nonzero((d < FAR) & (d <= last))
        order = np.lexsort((node[one[j]], d[i, j], i))
        i, j = i[order], j[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < most
        yield from zip(node[q[i[first]]].tolist(), node[one[j[first]]].tolist(), d[i[first], j[first]].tolist())


def _look_up(radius: int, similarity: float, most: int):
    """Rows of a unit, one or two parts of a shard, to candidates (node, near, d) in other components.

    Of what a node's lookup in the BK-tree finds there, nearest first, the first ``most`` behind its last place (``past_d``, ``past_near``).
    """

    def unit(groups: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for group in groups:
            if group["component"].nunique() < 2:
                continue
            own, alone = (group["c"] == group["i"]).to_numpy(), group["i"].iat[0] == group["j"].iat[0]
            one, two = np.flatnonzero(own), np.flatnonzero(~own)
            for places, asking in [(one, one)] if alone else [(one, two), (two, one)]:
                out += _nearest(group, places, asking, radius, similarity, most)
        if out:
            yield pd.DataFrame(out, columns=["node", "near", "d"])

    return unit


def members(docs: DataFrame, id: str, text: str, words: int, similarity: float) -> DataFrame:
    """``id`` and ``component`` of each document with an id."""
    spark = docs.sparkSession
    small_batches(spark)
    n, radius = int(spark.conf.get("spark.sql.shuffle.partitions")), radius_of(similarity)

    @F.pandas_udf("node long, n int, keys array<long>, fp binary, sketch binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, words) for t in texts]
        node = np.array([whole(s) for s in sets], dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"node": node, "n": [len(s) for s in sets], "keys": [keys(s) for s in sets], "fp": [fingerprint(s) for s in sets], "sketch": [sketch(s) for s in sets]})

    marked = stash(docs.filter(F.col(id).isNotNull()).select(F.col(id).alias("id"), of(F.col(text)).alias("s")).select("id", "s.*"))
    nodes = stash(marked.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "keys", "fp", "sketch")]))
    filed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = filed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("in_shard")).filter("in_shard > 1")
    cut = F.ceil(F.col("in_shard") / TREE).cast("int")
    met = stash(filed.join(sizes.repartition(n), ["band", "key"]).withColumn("parts", cut).withColumn("c", F.pmod(F.hash("node"), "parts")).drop("in_shard"))
    sets = _sets(docs, marked, met, id, text, words)

    def candidates(rows: DataFrame, state: DataFrame, most: int) -> DataFrame:
        pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("c", o).alias("i"), F.greatest("c", o).alias("j")))
        kept = ["band", "key", "c", *state.columns]
        units = rows.join(state, "node").select(*kept, F.explode(pair).alias("p")).select(*kept, "p.i", "p.j")
        units = units.repartition(n, "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "node")
        met = units.mapInPandas(_runs_of(["band", "key", "i", "j"], _look_up(radius, similarity, most)), "node long, near long, d int").distinct()
        place = F.row_number().over(W.partitionBy("node").orderBy("d", "near"))  # of all shards' candidates
        return met.withColumn("r", place).filter(F.col("r") <= most).drop("r")

    told, links, tested = met, None, None
    state = nodes.select("node", "n", "fp").withColumns({"component": F.col("node"), "past_d": F.lit(-1), "past_near": F.lit(0).cast("long")})
    for most in ROUNDS:
        tried = stash(candidates(told, state, most))
        pairs = tried.select(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).distinct()
        fresh = stash(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        right = _confirmed(sets, fresh, similarity)
        links = right if links is None else stash(right, to=links)
        found = stash(components(links))
        tested = fresh if tested is None else stash(fresh, to=tested)
        last = tried.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("d", "near")).alias("last")).filter(F.col("m") >= most)
        left = stash(last.select("node", F.col("last.d").alias("past_d"), F.col("last.near").alias("past_near")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
        discard(tried)
        if left.isEmpty():
            break
        now = stash(told.join(left.select("node", "component"), "node"))
        open_ = now.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band", "key")
        told = stash(now.drop("component").join(open_.repartition(n), ["band", "key"]))
        state = left.join(nodes.select("node", "n", "fp", "sketch"), "node")
        discard(now)
    named = stash(marked.select("id", "node").join(found, "node", "left").select("id", F.coalesce("component", "node").alias("component")))
    discard(nodes, met, sets, links, tested)
    return named
