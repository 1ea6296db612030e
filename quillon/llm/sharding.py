"""Sharding by rendezvous hashing.

Every shard draws a number for every record key from a hash of both; the shard
with the largest draw, scaled by its weight, gets the record (the logarithmic
method: ``-weight / ln(u)``).  A new shard can only win records for itself, so
growing from n to n + 1 equal shards moves about 1 / (n + 1) of the records and
none between old shards.  The choice looks at nothing but the key and the
shards: it is a projection without a shuffle.

Slots (positions inside a shard) come from bucketed prefix sums, see
:mod:`quillon.llm.prefix`; a shard is never gathered in one task.  Equal rows
are counted before they are numbered, so a row repeated a million times is one
row until the last step, and there it is dealt out in runs of ``RUN`` to all tasks.

Cases.  A null key is a key of its own.  A null text has no bytes, so its size
is 1.  Repeated rows go to one shard and get slots of their own.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.prefix import bucket, bucket_bits, offsets
from quillon.storage import stash

#: Slots of equal rows that one step writes out; longer runs are dealt to other tasks first.
RUN = 1 << 16

def rendezvous(key: Column, shards: int | Mapping[int, float]) -> Column:
    """The shard of ``key`` among ``shards``: a count of equal ones, or weights by number."""
    weights = dict.fromkeys(range(shards), 1.0) if isinstance(shards, int) else dict(shards)
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need positive weights")

    def draw(s: int, weight: float) -> Column:
        # 52 bits of the hash, moved off zero: strictly between 0 and 1
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 12).cast("double") + 0.5) / float(1 << 52)
        return F.struct((F.lit(-float(weight)) / F.ln(u)).alias("draw"), F.lit(s).alias("shard"))

    draws = [draw(s, w) for s, w in sorted(weights.items())]
    return (F.greatest(*draws) if len(draws) > 1 else draws[0])["shard"]


def assign(df: DataFrame, key: str, shards: int | Mapping[int, float], name: str = "shard") -> DataFrame:
    """Add the shard of each row; a column of that name is replaced."""
    return df.withColumn(name, rendezvous(F.col(key), shards))


def with_slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, as ``slot``."""
    names = rows.columns
    facts = [c for c in names if c != shard]
    equal = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    counted = equal.withColumn("__key", F.md5(F.to_json(F.struct(*facts))))
    counted = stash(counted)
    bits = bucket_bits(counted.count())
    counted = counted.withColumn("__bucket", bucket(F.col("__key"), bits))
    run = W.partitionBy(shard, "__bucket").orderBy("__key", *facts).rowsBetween(W.unboundedPreceding, -1)
    placed = counted.join(offsets(counted, [shard], "__n"), [shard, "__bucket"])
    first = F.col("__before") + F.coalesce(F.sum("__n").over(run), F.lit(0))
    placed = placed.withColumn("__first", first).select(*names, "__first", (F.col("__first") + F.col("__n") - 1).alias("__last"))
    slots = F.explode(F.sequence("__first", "__last")).alias("slot")
    few, many = placed.filter(F.col("__last") - F.col("__first") < RUN), placed.filter(F.col("__last") - F.col("__first") >= RUN)
    cut = many.withColumn("__first", F.explode(F.sequence(F.col("__first"), F.col("__last"), F.lit(RUN))))
    cut = cut.withColumn("__last", F.least(F.col("__last"), F.col("__first") + RUN - 1))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return few.select(*names, slots).unionByName(cut.repartition(parts, shard, "__first").select(*names, slots))


def shard_documents(docs: DataFrame, shards: int = 8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Size, checksum, shard and slot of each document, and its shard were there one more."""
    rows = docs.select(
        F.col(id),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(F.col(id), shards).alias("shard"),
        rendezvous(F.col(id), shards + 1).alias("grown_shard"),
    )
    return with_slots(rows).select(id, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
