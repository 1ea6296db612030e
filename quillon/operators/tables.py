"""Maintenance of mapping, catalog and history tables, as DataFrames in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.rewrite import mapping_key, normalize
from quillon.rules import tables as T


def last_of_batch(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key of a batch, the latest."""
    latest = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return batch.withColumn("__n", latest).filter("__n = 1").drop("__n")


def upsert(existing: DataFrame, batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``batch`` in place of those of equal key."""
    new = last_of_batch(batch, key, order) if order else batch
    return existing.join(new.select(key), key, "left_anti").unionByName(new.select(*existing.columns))


def upsert_counts(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """One row: how many keys of the batch are new (``added``) and how many replace one (``updated``)."""
    keys = batch.select(key).distinct().join(existing.select(key).distinct().withColumn("__old", F.lit(1)), key, "left")
    return keys.agg(F.count(F.when(F.col("__old").isNull(), 1)).alias("added"), F.count("__old").alias("updated"))


def upsert_mappings(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Mappings (query, code, note) keyed by their sanitised query; ``batch`` has an order column ``ix``."""
    keyed = lambda df: df.withColumn("__key", mapping_key(F.col("query")))
    return upsert(keyed(existing), keyed(batch), "__key", "ix").drop("__key")


def append_absent(existing: DataFrame, new: DataFrame, keys: list[Column | str], names: list[str] | None = None) -> DataFrame:
    """``existing`` and those rows of ``new`` whose keys it lacks, each key once."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    names = names or [f"__k{i}" for i in range(len(cols))]
    add = lambda df: df.withColumns(dict(zip(names, cols)))
    fresh = add(new).dropDuplicates(names).join(add(existing).select(*names), names, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def delete_rows(table: DataFrame, id: str, ids: list) -> DataFrame:
    return table.filter(~F.col(id).isin(ids))


def truncate(table: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return table.limit(0)


def update_row(table: DataFrame, id: str, value, changes: dict) -> DataFrame:
    hit = F.col(id) == value
    return table.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in changes.items()})


def insert_code(catalog: DataFrame, row: DataFrame, code: str = "code") -> DataFrame:
    """Add catalog rows whose code is not there yet, whatever its case."""
    return append_absent(catalog, row, [F.upper(F.trim(F.col(code)))])


def rename_allowed(catalog: DataFrame, id: str, value, new_code: str, code: str = "code") -> bool:
    """Whether no other row has the code."""
    return catalog.filter((F.col(id) != value) & (F.upper(F.trim(code)) == new_code.strip().upper())).isEmpty()


def upload(catalog: DataFrame | None, rows: DataFrame, code: str = "code", order: str = "ix") -> DataFrame:
    """Uploaded rows, the first of each code whatever its case; appended to ``catalog`` if one is given."""
    keyed = rows.filter(F.trim(F.coalesce(code, F.lit(""))) != "").withColumn("__key", F.upper(F.trim(code)))
    first = F.row_number().over(W.partitionBy("__key").orderBy(order))
    kept = keyed.withColumn("__n", first).filter("__n = 1").drop("__n")
    if catalog is None:
        return kept.drop("__key")
    old = catalog.withColumn("__key", F.upper(F.trim(code)))
    return catalog.unionByName(kept.join(old.select("__key"), "__key", "left_anti").select(*catalog.columns))


def retain(history: DataFrame, id: str = "id", most: int = T.KEEP_HISTORY) -> DataFrame:
    """The rows with the ``most`` greatest ids.

    The bound comes from a top-k of ids alone, one row; no window over the whole table.
    """
    least = history.select(id).orderBy(F.desc(id)).limit(most).agg(F.min(id).alias("__least"))
    return history.join(F.broadcast(least), F.col(id) >= F.col("__least")).drop("__least")


def page(history: DataFrame, limit: int = 500, offset: int = 0, id: str = "id") -> DataFrame:
    """Newest first; the limit is held to 1..2000, the offset to 0 or more."""
    return history.orderBy(F.desc(id)).offset(max(0, offset)).limit(min(2000, max(1, limit)))


def export(history: DataFrame, limit: int = 5000, id: str = "id") -> DataFrame:
    """(query, code, description) of rows that a model scored, newest first; the limit is held to 1..10000."""
    scored = history.filter(F.coalesce("method", F.lit("")) != "").filter("method <> 'EXACT_MATCH'")
    return scored.orderBy(F.desc(id)).limit(min(10000, max(1, limit))).select("query", "code", "description")


def stats(history: DataFrame, now: Column, at: str = "ts") -> DataFrame:
    """One row: all rows, those of the last hour and day, and the day's mean by hour and the hour's by minute."""
    within = lambda span: F.coalesce(F.sum(F.when(F.col(at) >= now - F.expr(f"INTERVAL {span}"), 1).otherwise(0)), F.lit(0))
    out = history.agg(F.count(F.lit(1)).alias("total"), within("1 HOUR").alias("last_hour"), within("24 HOUR").alias("last_day"))
    return out.withColumns({"per_hour": F.round(F.col("last_day") / 24, 1), "per_minute": F.round(F.col("last_hour") / 60, 1)})


def backfill(history: DataFrame, corrections: DataFrame, key: str = "normalized", at: str = "created_at", id: str = "id") -> DataFrame:
    """Write ``corrected_code`` into the latest uncorrected row of each key of ``corrections`` whose code was another one."""
    latest = history.filter("corrected_code IS NULL").groupBy(key).agg(F.max_by(F.struct(id, "code"), F.struct(at, id)).alias("l"))
    wrong = latest.join(corrections.select(key, F.col("code").alias("__right")), key).filter(F.col("l.code") != F.col("__right"))
    marks = wrong.select(F.col(f"l.{id}").alias(id), "__right")
    return history.join(marks, id, "left").withColumn("corrected_code", F.coalesce("corrected_code", "__right")).drop("__right")


def history_rows(matches: DataFrame, now: Column) -> DataFrame:
    """The best row of each query as history (without id)."""
    top = matches.filter("rank = 1")
    return top.select(
        now.alias("created_at"), "query", "normalized", "modality", "code", "description", "score", "method",
        F.lit(None).cast("string").alias("corrected_code"), F.lit(None).cast("timestamp").alias("corrected_at"),
    )


def correction_mapping(row: DataFrame, existing: DataFrame) -> DataFrame:
    """Append a correction unless that very (query, code) is there; it counts, as the last row of a key does."""
    keys = [normalize(F.col("query")), F.col("code")]
    return append_absent(existing, row, keys)


def health(catalog: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row: numbers of codes and mappings."""
    return catalog.agg(F.count(F.lit(1)).alias("codes")).join(F.broadcast(mappings.agg(F.count(F.lit(1)).alias("mappings"))))


def latency(log: DataFrame, ms: str = "ms", hit: str = "hit") -> DataFrame:
    """One row: least, mean and greatest latency, and hits."""
    return log.agg(F.min(ms).alias("least"), F.avg(ms).alias("mean"), F.max(ms).alias("most"), F.count(F.when(F.col(hit), 1)).alias("hits"))
