"""Connected components of a table of links, by alternating stars.

Large stars hang every larger neighbour of a node on the node's smallest
neighbour, small stars do so with the smaller ones; repeated, every component
becomes one star around its smallest node, in a number of rounds that grows with
the logarithm of the component's size.  Links never leave the cluster: each round
is two joins written to the shared folder, so a lost executor costs one step.
The minimum by node combines on the map side; the join that brings it back to the
node's links has a plain exchange on both sides, which adaptive execution splits
where one node has a large share of all links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.storage import discard, stash


def _with_min(links: DataFrame, least) -> DataFrame:
    """Links (u, v) with m, the smallest v of u (by the aggregate ``least``)."""
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mins = links.groupBy("u").agg(least.alias("m")).repartition(n)  # an exchange of its own, so that the join can split
    return links.join(mins, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of ``edges``.

    Links of a node to itself and links with a null end say nothing and are left
    out; repeated links count once.  No links give an empty result.
    """
    clean = edges.filter(F.col(a) != F.col(b))
    now = stash(clean.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both, F.least(F.min("v"), F.col("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(large.distinct())
        met = _with_min(large, F.min("v"))
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = stash(small.select("e.u", "e.v").filter("u != v").distinct())
        discard(now, large)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _is_stars(links: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e"))
    seen = ends.select("e.*").groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return seen.filter("ups > 1 OR (ups = 1 AND low = 0)").isEmpty()
