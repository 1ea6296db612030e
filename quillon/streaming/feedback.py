"""The feedback loop as streams: new mappings, corrections and pending suggestions."""

from __future__ import annotations

from collections.abc import Callable
from time import perf_counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions import rewrite
from quillon.operators import index, retrieve, tables
from quillon.sources.readers import MAPPING


def watch_mappings(spark: SparkSession, folder: str, own_note: str | None = None) -> DataFrame:
    """A stream of mapping files as they arrive; rows this system wrote itself (by note) are left out."""
    rows = spark.readStream.schema(MAPPING).option("header", False).csv(folder)
    return rows if own_note is None else rows.filter(F.coalesce("note", F.lit("")) != own_note)


def first_by_key(stream: DataFrame, key: Column, within: str | None = None, at: str = "ts") -> DataFrame:
    """The first row of each key; with ``within``, state older than that is dropped."""
    keyed = stream.withColumn("key", key)
    return keyed.dropDuplicates(["key"]) if within is None else keyed.withWatermark(at, within).dropDuplicatesWithinWatermark(["key"])


def pending_queue(stream: DataFrame, text: str = "query") -> DataFrame:
    """Pending suggestions: the first of each query, whatever its case and spacing."""
    return first_by_key(stream, rewrite.review_key(F.col(text)))


def rolling_counts(stream: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "1 hour", by: str | None = None) -> DataFrame:
    """Events by window, complete once nothing older than ``late`` can come."""
    groups = [F.window(at, window)] + ([F.col(by)] if by else [])
    out = stream.withWatermark(at, late).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *([by] if by else []), "n")


def changed_codes(batch: DataFrame, mappings: DataFrame, code: str = "code") -> DataFrame:
    """Mappings of those codes that a batch touches: what an incremental refresh reads."""
    return mappings.join(batch.select(code).distinct(), code, "left_semi")


def refresh_aliases(aliases: DataFrame, batch: DataFrame, mappings: DataFrame) -> DataFrame:
    """Alias tokens with the rows of changed codes made anew."""
    return tables.upsert(aliases, index.alias_tokens(changed_codes(batch, mappings)), "code")


def refresh_counts(counts: DataFrame, batch: DataFrame, mappings: DataFrame) -> DataFrame:
    """Examples per code with the rows of changed codes made anew."""
    return tables.upsert(counts, index.train_counts(changed_codes(batch, mappings)), "code")


def refresh_exact(exact: DataFrame, batch: DataFrame, mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Verified codes by key with the keys of the batch looked up anew."""
    return tables.upsert(exact, retrieve.exact_map(mappings.join(batch.select("norm").distinct(), "norm", "left_semi"), catalog), "norm")


def retrainer(spark: SparkSession, path: str, key: str, order: str, train: Callable[[DataFrame], object]) -> Callable[[DataFrame, int], None]:
    """A merge for :func:`apply_batches` that keeps the latest row of each key and trains on them.

    What arrives while training runs is one batch afterwards: requests coalesce.  Each batch
    leaves one row of status under ``path``/status.
    """
    keep = latest_merger(spark, f"{path}/state", key, order)

    def merge(batch: DataFrame, batch_id: int) -> None:
        began = perf_counter()
        keep(batch, batch_id)
        state = spark.read.parquet(f"{path}/state/v={batch_id}")
        trained = train(state) is not None
        row = state.agg(F.count(F.lit(1)).alias("examples")).select(F.lit(batch_id).alias("batch"), "examples", F.lit(trained).alias("trained"), F.lit(perf_counter() - began).alias("seconds"))
        row.write.mode("overwrite").parquet(f"{path}/status/b={batch_id}")

    return merge


def apply_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``merge(batch, id)`` on every micro-batch; ``once`` works off what there is and ends."""
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def latest_merger(spark: SparkSession, path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A merge for :func:`apply_batches`: one row for each key in versions of a Parquet table under ``path``.

    The row with the greatest ``order`` counts, whichever batch brings it, so that late rows
    do not displace newer ones; of equal ones the later batch's.  Each batch writes a version
    of its own, numbered by the batch, so that a repeated batch overwrites its own version and
    nothing else.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumn("__order", F.struct(F.col(order).alias("at"), F.lit(batch_id).alias("batch")))
        if batch_id:
            new = spark.read.parquet(f"{path}/v={batch_id - 1}").unionByName(new)
        tables.last_of_batch(new, key, "__order").write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return merge
