"""Exact deduplication by two passes over Bloom filters.

Pass 1 throws every row's hash into a blocked Bloom filter and keeps the cells
that at least two different rows have hit.  Pass 2 looks each row up in those
cells: a row with a cell that nobody else hit has no copy and passes straight
through; only the others (copies and a few false alarms) shuffle, by the SHA-256
of their normalised text, and are grouped exactly.

Scale.  One filter is broadcast at a time, and its size is set, not found: rows
are dealt into as many hash slices as it takes to keep one slice's filter under
``FILTER_BITS``.  All filters are built by one pass over a slim table, which shuffles
three cells of 16 bytes for a row, combined on the map side, and no text.  With more
than one slice the looked-up table is first written split by slice, and each slice is
then read alone, so that texts are read once for the hashes and, where documents are
wanted back, once more to be written by slice.  Rows that shuffle after the look-up carry
a hash, a length and an id, not their text, unless the caller asks for whole documents
back.  Groups are reduced with map-side combining, and the join that hands the answer back
to a group's rows has the reduced table materialised on its other side, so that adaptive
execution can split a hot group.

Cases.  A null text counts as empty, and empty texts are equal to each other.
A null id loses against any other id and is reported as null.  Rows that repeat
an id and a text are one document delivered twice: they get the same answer in
:func:`copy_groups`, and :func:`drop_copies` lets one of them stay.  An empty
table gives an empty result.  Other columns are carried untouched whatever their
names; the operator's own columns carry the prefix ``__dd_`` until the end.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.storage import discard, stash

#: Characters that do not count when texts are compared.
SPACE = r"[\x20\x09-\x0D]+"
#: Cells of the filter for each row, and bits in one block (32 words of 64).
BITS_PER_ROW, BLOCK_BITS = 16, 2048
#: Most bits of one broadcast filter: 64 MB as words.
FILTER_BITS = 1 << 29


def keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the SHA-256 and XXH64 of the normalised text and the length of the original."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn("__dd_norm", F.regexp_replace(raw, SPACE, "")).select(
        *[docs[c] for c in docs.columns],
        F.sha2(F.col("__dd_norm"), 256).alias("__dd_sha"),
        F.xxhash64("__dd_norm").alias("__dd_h"),
        F.length(raw).cast("long").alias("__dd_len"),
    )


def _cell(blocks: int) -> tuple[Column, list[Column]]:
    """The block of a hash and its three bits there."""
    h = F.xxhash64(F.col("__dd_h"), F.lit(1))
    bits = F.xxhash64(F.col("__dd_h"), F.lit(2))
    return F.pmod(h, F.lit(blocks)).cast("int"), [
        F.shiftrightunsigned(bits, 11 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(3)
    ]


def _slice(slices: int) -> Column:
    return F.pmod(F.xxhash64(F.col("__dd_h"), F.lit(0)), F.lit(slices)).cast("int")


def repeat_filter(keyed: DataFrame, blocks: int, slices: int = 1) -> DataFrame:
    """Pass 1: one row for each slice and block, with the cells that two rows or more have hit.

    At most ``blocks`` rows of 32 words each for a slice.
    """
    block, bits = _cell(blocks)
    by = ["__dd_slice", "__dd_block"]
    hits = (
        keyed.select(_slice(slices).alias("__dd_slice"), block.alias("__dd_block"), F.explode(F.array_distinct(F.array(*bits))).alias("bit"))
        .groupBy(*by, "bit")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    words = hits.groupBy(*by, F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits"))
    found = words.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)))
    return found.select(*by, dense.alias("__dd_words"))


def suspects(keyed: DataFrame, cells: DataFrame, blocks: int) -> DataFrame:
    """Pass 2: add the boolean ``__dd_seen``, true where every cell was hit twice."""
    block, bits = _cell(blocks)
    word = lambda b: F.expr("__dd_words")[F.shiftright(b, 6)]
    hit = reduce(Column.__and__, [F.getbit(word(b), b.bitwiseAND(F.lit(63))) == 1 for b in bits])
    return (
        keyed.withColumn("__dd_block", block)
        .join(F.broadcast(cells), "__dd_block", "left")
        .withColumn("__dd_seen", F.coalesce(hit, F.lit(False)))
        .drop("__dd_block", "__dd_words")
    )


class CopyIndex:
    """What the two passes know of a table; kept in the shared folder."""

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", filter_bits: int = FILTER_BITS):
        self.id = id
        self.slim = stash(keys(docs.select(id, text), text).drop(text))
        n = self.slim.count()
        self.slices = max(1, ceil(n * BITS_PER_ROW / filter_bits))
        self.blocks = max(1, ceil(n * BITS_PER_ROW / BLOCK_BITS / self.slices))
        self.cells = stash(repeat_filter(self.slim, self.blocks, self.slices), *["__dd_slice"] * (self.slices > 1))
        self.told = self.marked(self.slim)
        first = F.min(F.struct(-F.col("__dd_len"), F.col(id).isNull(), F.col(id).alias("id")))
        self.groups = stash(
            self.told.filter("__dd_seen")
            .groupBy("__dd_sha")
            .agg(first.alias("f"), F.count(F.lit(1)).alias("__dd_size"))
            .filter("__dd_size > 1")
            .select("__dd_sha", F.col("f.id").alias("__dd_keep"), (-F.col("f.col1")).alias("__dd_klen"), "__dd_size")
        )

    def marked(self, keyed: DataFrame) -> DataFrame:
        """``keyed`` with ``__dd_seen``; slice by slice, one filter broadcast at a time, where there are several."""
        if self.slices == 1:
            return suspects(keyed, self.cells.drop("__dd_slice"), self.blocks)
        salted = keyed.withColumn("__dd_slice", _slice(self.slices)).withColumn("__dd_salt", F.spark_partition_id() % 64)  # a hot slice takes many tasks
        by_slice = stash(salted.repartition("__dd_slice", "__dd_salt").drop("__dd_salt"), "__dd_slice")
        done = None
        for s in range(self.slices):
            own = lambda df: df.filter(F.col("__dd_slice") == s).drop("__dd_slice")  # noqa: B023, E731
            done = stash(suspects(own(by_slice), own(self.cells), self.blocks), to=done)
        discard(by_slice)
        return done

    def resolve(self, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that pass straight through, and the shuffled rest; both with the answer's columns."""
        own = F.col(self.id)
        alone = marked.filter(~F.col("__dd_seen")).withColumns(
            {"__dd_keep": own, "__dd_klen": F.col("__dd_len"), "__dd_size": F.lit(1).cast("long")}
        )
        met = marked.filter("__dd_seen").join(self.groups, "__dd_sha", "left")
        met = met.withColumns(
            {
                "__dd_keep": F.when(F.col("__dd_size").isNull(), own).otherwise(F.col("__dd_keep")),
                "__dd_klen": F.coalesce("__dd_klen", "__dd_len"),
                "__dd_size": F.coalesce("__dd_size", F.lit(1).cast("long")),
            }
        )
        kept = own.eqNullSafe(F.col("__dd_keep")) & (F.col("__dd_len") == F.col("__dd_klen"))
        return alone.withColumn("__dd_kept", F.lit(True)), met.withColumn("__dd_kept", kept)


def copy_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and text_sha256."""
    index = CopyIndex(docs, id, text, filter_bits)
    alone, met = index.resolve(index.told)
    return alone.unionByName(met).select(
        id,
        F.col("__dd_keep").alias("keep_id"),
        F.col("__dd_size").alias("group_size"),
        F.col("__dd_kept").alias("kept"),
        F.col("__dd_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """The documents that stay, with all their columns; unsuspected rows are not shuffled."""
    index = CopyIndex(docs, id, text, filter_bits)
    discard(index.slim)
    alone, met = index.resolve(index.marked(keys(docs, text)))
    met = met.filter("__dd_kept").dropDuplicates([id, "__dd_sha"])
    return alone.unionByName(met).select(*[F.col(f"`{c}`") for c in docs.columns])
