"""Positions and running sums over a table too large for one window.

Rows of a group are ordered by a hash-random text key.  The key's leading digits
deal a group into range buckets; buckets are summed with map-side combining, a
window over the buckets alone gives each bucket's offset, and a window inside
one bucket does the rest.  With about the square root of the row count as number
of buckets, neither window ever holds more than that order of rows, also where
one group owns a third of the table.
"""

from __future__ import annotations

from math import ceil, log2, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.storage import stash


def bucket_bits(n: int) -> int:
    """Bits of the key that name a bucket, for a table of ``n`` rows."""
    return max(0, min(28, ceil(log2(max(1.0, sqrt(n))))))


def bucket(hex_key: Column, bits: int) -> Column:
    """The bucket of a key of hexadecimal digits; it follows the key's order."""
    return F.shiftright(F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("long"), 32 - bits)


def offsets(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """For each group and bucket: ``__before``, the sum of ``value`` in earlier buckets, and ``__all``, the group's."""
    sums = rows.groupBy(*by, "__bucket").agg(F.sum(value).alias("__sum"))
    w = W.partitionBy(*by)
    run = w.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    return sums.select(
        *by, "__bucket", F.coalesce(F.sum("__sum").over(run), F.lit(0)).alias("__before"), F.sum("__sum").over(w).alias("__all")
    )


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``, the position from 0 by ``order`` over the whole table, without one task holding it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()))
    sizes = dealt.groupBy("__pid").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition at most
    before = sizes.select("__pid", (F.sum("n").over(W.orderBy("__pid")) - F.col("n")).alias("__start"))
    place = F.row_number().over(W.partitionBy("__pid").orderBy(*order)) - 1
    return dealt.withColumn("__place", place).join(F.broadcast(before), "__pid").withColumn(
        name, F.col("__place") + F.col("__start")
    ).drop("__pid", "__place", "__start")
