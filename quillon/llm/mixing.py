"""Mixing sources to target weights.

Each source gets a budget of words: its weight's share of the wanted total, but
at most ``max_epochs`` times what the source has; what a full source cannot take
is shared again by weight among the others (:func:`targets`).  Inside a source
rows are ordered by a hash-random key, running sums of their sizes are taken over
range buckets (:mod:`quillon.llm.prefix`), and the order is cut where the budget
ends: whole epochs first, then the rows before the cut once more, and of the row
at the cut as many words as are left.

Scale.  Nothing is gathered by source: a hot source is spread over its buckets.
Sharing the budget iterates over two sums of the table of sources, not over its
rows; sources are numbered by a distributed sort.

Cases.  A null text has size 0, a null source is the last one.  Rows that repeat
an id stand next to each other in the order, told apart by size and source only.
If all sizes are 0, all targets are 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.prefix import bucket, bucket_bits, numbered, offsets
from quillon.storage import stash

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by position of the source, repeating; the share of all words; the most epochs of a source.
WEIGHTS, SHARE, MAX_EPOCHS = (3, 1, 2), 1.5, 2
#: Most sources whose cuts are broadcast.
SOURCES = 100_000


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Ids, sources and sizes with their hash-random key and range bucket, in the shared folder."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = stash(docs.select(F.col(id), F.col(source), words.alias("size")))
    key = F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))
    return slim.withColumn("__key", key).withColumn("__bucket", bucket(F.col("__key"), bucket_bits(slim.count())))


def targets(sizes: DataFrame, source: str = "source", weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The table of sources with ``source_size``, ``weight`` and ``target``."""
    order = [f"{source} IS NULL", source]
    ranked = numbered(
        sizes.groupBy(source).agg(F.sum("size").alias("source_size")).withColumn("__last", F.expr(order[0])), ["__last", source], "__rank"
    ).drop("__last")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    table = stash(ranked.select(source, "source_size", weight.alias("weight")))
    cap = F.col("source_size") * max_epochs
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = F.col("weight")
    full, open_ = 0, table.agg(F.sum("weight")).first()[0]
    if not open_:
        return table.withColumn("target", F.lit(0.0))
    while True:  # a source once full stays full, so this ends; in practice after a few rounds
        level = F.col("weight") * (total - full) / open_
        now = table.agg(
            F.sum(F.when(cap <= level, cap).otherwise(0)).alias("full"), F.sum(F.when(cap <= level, 0.0).otherwise(F.col("weight"))).alias("open")
        ).first()
        if not now["open"] or (now["full"], now["open"]) == (full, open_):
            return table.withColumn("target", F.when(cap <= level, cap.cast("double")).otherwise(level))
        full, open_ = now


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: id, source, size, source_size, target and taken words."""
    rows = sized(docs, id, text, source)
    plan = targets(rows, source, weights, share, max_epochs)
    by = [F.coalesce(F.col(source), F.lit("")).alias("__name"), F.col(source).isNull().alias("__none")]
    rows = rows.select("*", *by)
    where = offsets(rows, ["__name", "__none"], "size").join(plan.select(*by, "source_size", "target"), ["__name", "__none"])
    placed = rows.join(where, ["__name", "__none", "__bucket"])
    run = W.partitionBy("__name", "__none", "__bucket").orderBy("__key", id, "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("__before") + F.coalesce(F.sum("size").over(run), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("__run", before).withColumn("__epochs", epochs.cast("long"))
    left = (F.floor("target") - F.col("__epochs") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("__run")))
    return placed.select(
        id, source, "size", "source_size", "target", (F.col("__epochs") * F.col("size") + part).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents of the mix, a row for each time, with the columns of ``docs``.

    The row at the cut comes once more with its first words only, as many as the
    budget has left, and ``n_chars`` (where there is such a column) of that text.
    Texts are not shuffled by source: what each source's order takes is told by its
    cut, one small row, and those rows are broadcast only while there are at most
    ``SOURCES`` of them; beyond that they are joined.  Rows that repeat the id at the
    cut share one cut text.
    """
    plan = mix(docs, id, text, source, weights, share, max_epochs)
    key = F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))
    per = plan.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    more = F.col("taken") - F.col("__epochs") * F.col("size")
    last = F.max(F.when(more > 0, F.struct(key.alias("key"), (more < F.col("size")).alias("partly"), more.alias("words"))))
    cuts = stash(per.groupBy(source).agg(F.max("__epochs").alias("__epochs"), last.alias("__cut")).withColumnRenamed(source, "__src"))
    small = F.broadcast(cuts) if cuts.count() <= SOURCES else cuts
    told = docs.withColumn("__key", key).join(small, docs[source].eqNullSafe(F.col("__src")), "left")
    before = (F.col("__key") < F.col("__cut.key")) | (F.col("__key") == F.col("__cut.key")) & ~F.col("__cut.partly")
    at = F.coalesce((F.col("__key") == F.col("__cut.key")) & F.col("__cut.partly"), F.lit(False))
    times = F.coalesce("__epochs", F.lit(0)) + F.when(F.coalesce(before, F.lit(False)) | at, 1).otherwise(0)
    rows = told.withColumn("__at", at).withColumn("__times", times).filter("__times > 0")
    rows = rows.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    words = F.array_join(F.slice(words, 1, F.col("__cut.words").cast("int")), "")
    head = F.when(F.col("__at") & (F.col("__time") == F.col("__times")), words)
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {text: F.coalesce(head, F.col(text))}
    if n_chars in docs.columns:
        out[n_chars] = F.when(head.isNotNull(), F.length(head).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars))
    return rows.select(*[c.alias(name) for name, c in out.items()])
