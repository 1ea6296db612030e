"""SimHash near-deduplication with BK-trees.

A document's fingerprint is the bitwise majority of the XXH64 of its word
shingles.  Fingerprints within ``radius`` bits of each other link, and documents
reachable by links form a component.

Search.  The 64 bits are cut into ``blocks`` ranges.  Two fingerprints that differ
in at most ``radius`` bits agree on at least ``blocks - radius`` of the ranges, so
each is filed under every choice of that many ranges, and a link is found in at
least one such shard: nothing is missed.  A shard's fingerprints go into a BK-tree
(children keyed by their Hamming distance to the parent), and a lookup follows only
the edges whose distance is within the radius of its own distance to the node.
The number of ranges follows from the number of fingerprints, so that a shard of
evenly spread ones stays small.

Scale.  Equal fingerprints are one node.  Shards of one fingerprint are dropped in
the JVM; a larger one becomes trees of at most ``TREE`` fingerprints, built where its
rows are.  Trees are broadcast in slices of measured size, ``SLICE_BYTES`` each, one
after the other, and all fingerprints look their shards up in place, without a shuffle of
their own.  As all trees together grow with the corpus, that is done for up to ``SLICES``
slices; beyond them (the log says so) the trees stay where they are and their queries come to
them.  Either way a task reports a spanning forest of the links that it finds, never all pairs.
Components come from :mod:`quillon.llm.components`.

Similarity.  :func:`keep_one` takes the same operator to five-word shingles and a similarity
of at least 0.8, see :mod:`quillon.llm.simhash_similarity`.

Cases.  A null text counts as empty; a text without words has fingerprint zero and
links like any other.  A null id cannot be a node: such a document's component is
that of other documents with its fingerprint, or null.  Repeated rows are
equal rows of the answer.  Long texts are hashed whole, in pieces of bounded size.
An empty table gives an empty result.
"""

from __future__ import annotations

import logging
from array import array
from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.workers import small_batches
from quillon.storage import discard, stash

LOG = logging.getLogger(__name__)
SEED, WORDS, RADIUS = 42, 4, 4
#: Fingerprints of one tree; expected fingerprints in a shard before more ranges are used; hashes held at once.
TREE, SHARD, PIECE = 2048, 64, 1 << 15
#: Bytes of a fingerprint in a tree that is sent (itself, its node, first child, next sibling, edge); bytes of a slice of trees; most slices.
ENTRY, SLICE_BYTES, SLICES = 25, 32 << 20, 64


def shingle_spans(text: str | None, words: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The words of a text (A-Z lower-cased, split at ASCII white space) with single spaces, and where its shingles are."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return b"", []
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    k = min(words, len(parts))
    return b" ".join(parts), list(zip((ends - sizes)[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()))


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text."""
    line, spans = shingle_spans(text, words)
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(spans), PIECE):
        some = [digest(line[a:b], seed) for a, b in spans[at : at + PIECE]]
        ones += np.unpackbits(np.array(some, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a signed long."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id), of(F.col(text)).alias("fp"))


class BKTree:
    """Integers under Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        if not new:
            return
        at = 0
        while True:
            d = (value ^ self.values[at]).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new
                return
            at = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places (in the order of adding) of all values at most ``radius`` away."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                yield at
            for edge, below in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(below)


class Forest:
    """Spanning links of what has been met so far."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        root = self.root
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def meet(self, a: int, b: int) -> None:
        x, y = self._find(a), self._find(b)
        if x != y:
            self.root[x] = y
            self.links.append((a, b))

    def told(self) -> list[tuple[int, int]]:
        """Links found since the last call."""
        out, self.links = self.links, []
        return out


def forest(tree_values: list[int], tree_nodes: list[int], queries: list[int], query_nodes: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one unit; without queries, of the tree's own."""
    found, tree = Forest(), BKTree()
    for value, node in zip(tree_values, tree_nodes):
        if not queries:
            for other in tree.within(value, radius):
                found.meet(node, tree_nodes[other])
        tree.add(value)
    for value, node in zip(queries, query_nodes):
        for other in tree.within(value, radius):
            found.meet(node, tree_nodes[other])
    return found.told()


_FLAT = "t int, k long, fp array<long>, node array<long>, first array<int>, next array<int>, edge array<int>"


def flat(tree: BKTree) -> tuple[list[int], list[int], list[int]]:
    """First child, next sibling and edge to the parent of every place of a tree; -1 for none."""
    n = len(tree.values)
    first, following, edge = [-1] * n, [-1] * n, [0] * n
    for at, below in enumerate(tree.children):
        before = -1
        for d, child in below.items():
            edge[child], following[child] = d, before
            before = child
        first[at] = before
    return first, following, edge


class SentTrees:
    """Trees of many shards in a few arrays, as they are broadcast."""

    def __init__(self, rows) -> None:
        """``rows``: an Arrow table of ``_FLAT``."""
        rows = rows.sort_by([("t", "ascending"), ("k", "ascending")])
        t, k = (rows.column(c).to_numpy() for c in ("t", "k"))
        whole = {c: rows.column(c).combine_chunks() for c in ("fp", "node", "first", "next", "edge")}
        sizes = np.diff(whole["fp"].offsets.to_numpy()) if len(t) else np.zeros(0, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tolist()
        values = lambda c, kind: array(kind, whole[c].flatten().to_numpy().astype(kind).tobytes())
        self.fp, self.node = values("fp", "q"), values("node", "q")
        self.first, self.next, self.edge = values("first", "i"), values("next", "i"), values("edge", "b")
        self.shards = {int(x): (k[t == x], int(np.searchsorted(t, x))) for x in np.unique(t)}

    def lookup(self, fps: np.ndarray, nodes: list[int], keys: dict[int, np.ndarray], radius: int, found: Forest) -> None:
        """Meet each fingerprint with all within ``radius`` in the trees of its shards."""
        values = fps.view(np.uint64).tolist()
        for t, (known, base) in self.shards.items():
            at = np.searchsorted(known, keys[t])
            hit = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == keys[t]))
            for row in hit.tolist():
                tree = int(at[row])
                while tree < len(known) and known[tree] == keys[t][row]:  # a large shard has several trees
                    for other in self.within(base + tree, values[row], radius):
                        if other != nodes[row]:
                            found.meet(nodes[row], other)
                    tree += 1

    def within(self, tree: int, value: int, radius: int) -> Iterator[int]:
        """Nodes of one tree at most ``radius`` away."""
        start, mask = self.starts[tree], (1 << 64) - 1
        todo = [start]
        while todo:
            at = todo.pop()
            d = (value ^ (self.fp[at] & mask)).bit_count()
            if d <= radius:
                yield self.node[at]
            child = self.first[at]
            while child >= 0:
                if d - radius <= self.edge[start + child] <= d + radius:
                    todo.append(start + child)
                child = self.next[start + child]


def _ranges(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each range."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def choose_blocks(n: int, radius: int = RADIUS) -> int:
    """Ranges for ``n`` fingerprints: two more than the radius, or as many as keep shards small."""
    blocks = radius + 2
    while blocks < 16 and n / 2 ** (64 * (blocks - radius) / blocks) > SHARD:
        blocks += 1
    return blocks


def shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """Array of (choice, key) under which a fingerprint is filed."""
    cut = _ranges(blocks)
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(0).cast("long")
        for c in chosen:
            low, bits = cut[c]
            part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
            key = F.shiftleft(key, bits).bitwiseOR(part)
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("k")))
    assert len(keys) == comb(blocks, radius)
    return F.array(*keys)


def shard_keys_of(fps: np.ndarray, blocks: int, radius: int) -> dict[int, np.ndarray]:
    """What :func:`shard_keys` says, for an array of signed fingerprints."""
    cut, unsigned = _ranges(blocks), fps.view(np.uint64)
    out = {}
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = np.zeros(len(fps), dtype=np.uint64)
        for c in chosen:
            low, bits = cut[c]
            key = key << np.uint64(bits) | unsigned >> np.uint64(low) & np.uint64((1 << bits) - 1)
        out[t] = key.view(np.int64)
    return out


def _runs_of(columns: list[str], unit):
    """``unit`` over the rows of each run of equal ``columns`` of sorted rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = batch[columns].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            yield from unit([batch.iloc[a:b] for a, b in zip(cuts, cuts[1:])])
            rest = batch.iloc[cuts[-1] :]
        if rest is not None and len(rest):
            yield from unit([rest])

    return run


def _values(group: pd.DataFrame) -> list[int]:
    return group["fp"].to_numpy().view(np.uint64).tolist()


def _build(groups: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one tree each to the tree."""
    out = []
    for group in groups:
        tree = BKTree()
        for value in _values(group):
            tree.add(value)
        out.append((group["t"].iat[0], group["k"].iat[0], group["fp"].to_numpy(), group["node"].to_numpy(), *flat(tree)))
    if out:
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _FLAT.split(", ")])


def _meet(radius: int):
    """Rows of a unit, one or two parts of a shard, to its links."""

    def unit(groups: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for group in groups:
            own = (group["c"] == group["i"]).to_numpy()
            if own.all() and group["i"].iat[0] != group["j"].iat[0]:
                continue
            tree, asks = group[own], group[~own]
            out += forest(_values(tree), tree["node"].tolist(), _values(asks), asks["node"].tolist(), radius)
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    return unit


def _look_up(shipped, blocks: int, radius: int):
    """Fingerprints (fp, node) to links with the broadcast trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Forest()
        for batch in batches:
            fps = batch["fp"].to_numpy()
            shipped.value.lookup(fps, batch["node"].tolist(), shard_keys_of(fps, blocks, radius), radius, found)
            if out := found.told():
                yield pd.DataFrame(out, columns=["a", "b"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links (a, b) that connect all of ``nodes`` (fp, node) that are within ``radius`` bits; spanning forests."""
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = choose_blocks(nodes.count(), radius)
    filed = nodes.select("fp", "node", F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("s")).select("fp", "node", "s.t", "s.k")
    sizes = filed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / tree).cast("int")
    met = stash(filed.join(sizes.repartition(n), ["t", "k"]).withColumn("parts", parts).withColumn("c", F.pmod(F.hash("fp"), "parts")).drop("n"))
    slices = ceil(met.count() * ENTRY / SLICE_BYTES)
    if slices > SLICES:
        LOG.warning("%d slices of trees are more than the %d that are broadcast; queries are sent to their trees", slices, SLICES)
        pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("c", o).alias("i"), F.greatest("c", o).alias("j")))
        units = met.select("fp", "node", "t", "k", "c", F.explode(pair).alias("p")).select("fp", "node", "t", "k", "c", "p.i", "p.j")
        units = units.repartition(n, "t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "c")
        return units.mapInPandas(_runs_of(["t", "k", "i", "j"], _meet(radius)), "a long, b long")
    rows = met.repartition(n, "t", "k", "c").sortWithinPartitions("t", "k", "c").select("t", "k", "c", "fp", "node")
    trees = rows.mapInPandas(_runs_of(["t", "k", "c"], _build), _FLAT)
    trees = stash(trees.withColumn("s", F.pmod(F.xxhash64("t", "k", F.element_at("node", 1)), F.lit(max(1, slices))).cast("int")), "s")
    found = None
    for s in range(max(1, slices)):
        sent = spark.sparkContext.broadcast(SentTrees(trees.filter(F.col("s") == s).drop("s").toArrow()))
        found = stash(nodes.select("fp", "node").mapInPandas(_look_up(sent, blocks, radius), "a long, b long"), to=found)
        sent.unpersist()
    discard(met, trees)
    return found


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fingerprint (16 hexadecimal digits) and component_id."""
    marked = stash(fingerprints(docs, id, text, words))
    nodes = stash(marked.groupBy("fp").agg(F.min(id).alias("node")))
    found = components(links(nodes.filter("node IS NOT NULL"), radius))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(stash(named), "fp").select(id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each component of documents whose sets of shingles have a similarity of at least ``similarity``, the smallest id, with all its columns.

    Documents without an id stay.  Candidates are fingerprints near each other in a shard's BK-tree; each is confirmed exactly.
    """
    from quillon.llm.simhash_similarity import members

    named = members(docs, id, text, words, similarity)
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    gone = named.join(least, "component").filter("id != least").select(F.col("id").alias("__gone")).distinct()
    return docs.join(stash(gone), docs[id] == F.col("__gone"), "left_anti")
