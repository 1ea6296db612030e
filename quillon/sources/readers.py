"""Readers and writers of catalogs, mappings, rules, history and settings."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import extract, rewrite
from quillon.rules import tables as T

CATALOG = "`Code` string, `Laterality` string, `Contrast` string, `XR#Views` string, `description` string, `modality` string, `bodyRegion` string"
MAPPING = "query string, code string, note string"
HISTORY = "id bigint, created_at timestamp, query string, normalized string, modality string, code string, description string, score int, method string, corrected_code string, corrected_at timestamp"


def with_ordinal(df: DataFrame, name: str = "ix") -> DataFrame:
    """A number that follows the order of the files' rows; unique, not gapless."""
    return df.withColumn(name, F.monotonically_increasing_id())


def with_row_number(df: DataFrame, name: str = "ix") -> DataFrame:
    """A gapless number from 0 in the order of the files' rows.

    Partitions keep that order, so a count for each of them gives where it starts; no
    task sees the whole table.
    """
    dealt = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__pid", F.shiftright("__at", 33))
    sizes = dealt.groupBy("__pid").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    starts = sizes.select("__pid", (F.sum("n").over(W.orderBy("__pid")) - F.col("n")).alias("__start"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(starts), "__pid").withColumn(name, F.col("__start") + place).drop("__at", "__pid", "__start")


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows as text, by the names in the header, with an ordinal.  Missing columns are null."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in raw.columns})
    have = {c.lower(): c for c in raw.columns}
    if not {"code", "description"} <= set(have):
        raise ValueError("a catalog needs the columns Code and description")
    wanted = ["Code", "Laterality", "Contrast", "XR#Views", "description", "modality", "bodyRegion", "long_description"]
    return with_ordinal(raw.select(*[(F.col(f"`{have[w.lower()]}`") if w.lower() in have else F.lit(None).cast("string")).alias(w) for w in wanted]))


def enrich_catalog(raw: DataFrame, ignored=T.IGNORED_CODES) -> DataFrame:
    """Typed catalog rows; rows without a code, and test codes, are left out."""
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    rows = raw.withColumn("code", text("Code")).filter((F.col("code") != "") & ~F.col("code").isin(*ignored))
    norm = rewrite.normalize(text("description"))
    return rows.select(
        "ix",
        "code",
        text("description").alias("description"),
        text("long_description").alias("long_description"),
        norm.alias("desc"),
        extract.catalog_modality(F.col("modality")).alias("modality"),
        extract.catalog_laterality(F.col("Laterality")).alias("laterality"),
        extract.catalog_contrast(F.col("Contrast")).alias("contrast"),
        extract.catalog_views(F.col("`XR#Views`")).alias("views"),
        extract.catalog_regions(F.col("bodyRegion")).alias("regions"),
        extract.states_least_views(text("description")).alias("least_views"),
    ).withColumn("tokens", rewrite.tokens(F.col("desc")))


def read_mappings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Mappings without a header; rows of a single cell are left out."""
    raw = spark.read.schema(MAPPING).option("header", False).option("multiLine", True).option("escape", '"').csv(path)
    return with_ordinal(raw).filter(F.col("code").isNotNull())


def read_mappings(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """Mappings to known codes, with the normalised query ``norm``."""
    known = read_mappings_csv(spark, path).withColumn("code", F.trim("code")).join(catalog.select("code"), "code", "left_semi")
    return known.withColumn("norm", rewrite.normalize(F.col("query")))


def mapping_listing(mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mappings with their code's description, empty where the code is unknown."""
    return mappings.join(catalog.select("code", "description"), "code", "left").withColumn("description", F.coalesce("description", F.lit("")))


def legend(catalog: DataFrame) -> DataFrame:
    return catalog.select("code", "description", "modality")


def read_rules(spark: SparkSession, path: str) -> list[rewrite.Rule]:
    """User rules of a JSON file, an object with ``replacements`` or a bare list; bad entries are left out."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    data = json.loads(text or "[]")
    entries = data.get("replacements", []) if isinstance(data, dict) else data
    return rewrite.valid_rules([(e["pattern"], e["replacement"]) for e in entries if isinstance(e, dict) and "pattern" in e and "replacement" in e])


def write_catalog_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_mappings_csv(rows: DataFrame, path: str) -> None:
    rows.select("query", "code", "note").write.mode("overwrite").option("header", False).csv(path)


def write_seed(pairs: DataFrame, path: str, note: str = "seeded variant") -> None:
    """Overwrite a mapping file with generated pairs (code, variant)."""
    write_mappings_csv(pairs.select(F.col("variant").alias("query"), "code", F.lit(note).alias("note")), path)


def write_template(spark: SparkSession, path: str) -> None:
    """An empty catalog to fill in: the header and two rows that show the forms of values."""
    rows = [("SAMPLE1", "N/A", "WOC", "1", "CT Chest wo IV Contrast", "CT", "CHEST"), ("SAMPLE2", "RIGHT", "N/A", "3", "XR Ankle Right 3 Views", "XR", "ANKLE")]
    write_catalog_csv(spark.createDataFrame(rows, CATALOG).coalesce(1), path)


def write_rules(spark: SparkSession, rules: list[rewrite.Rule], path: str) -> None:
    """Save the valid ones of ``rules`` in the form that :func:`read_rules` reads."""
    data = {"replacements": [{"pattern": p, "replacement": r} for p, r in rewrite.valid_rules(rules)]}
    spark.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Append rows; :func:`quillon.operators.tables.retain` compacts from time to time."""
    rows.write.mode("append").parquet(path)


def reload(frame: DataFrame, read) -> DataFrame:
    """Let go of a cached frame and read it again."""
    frame.unpersist()
    return read().cache()


def file_marks(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, size, time of change) of the files behind a path, in any store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in store.listStatus(target)) if store.exists(target) else []


class Watched:
    """A table that is read again when its files change; ``made`` (an index, a matcher) is then made anew."""

    def __init__(self, spark: SparkSession, path: str, read: Callable[[], DataFrame], make: Callable[[DataFrame], object] = lambda df: df):
        self.spark, self.path, self.read, self.make = spark, path, read, make
        self.marks: list[tuple[str, int, int]] | None = None
        self.frame: DataFrame | None = None

    def get(self) -> object:
        """What was made of the files as they are now."""
        now = file_marks(self.spark, self.path)
        if now != self.marks:
            if self.frame is not None:
                self.frame.unpersist()
            self.frame, self.marks = self.read().cache(), now
            self.made = self.make(self.frame)
        return self.made


@dataclass(frozen=True)
class Settings:
    """What a deployment may set."""

    min_score: int = T.MIN_SCORE
    max_results: int = T.MAX_RESULTS
    review: bool = False
    schedule: str | None = None
    api_key: str | None = field(default=None, repr=False)

    @classmethod
    def merged(cls, data: dict) -> Settings:
        """Defaults, with the known entries of ``data`` in their types; bad numbers are ignored."""
        out = {}
        for name, default in asdict(cls()).items():
            value = data.get(name, default)
            if isinstance(default, int) and not isinstance(default, bool):
                try:
                    value = int(value)
                except (TypeError, ValueError):
                    value = default
            out[name] = value
        return cls(**out)

    def shown(self) -> dict:
        """For display: the key is masked."""
        key = self.api_key and "*" * max(0, len(self.api_key) - 4) + self.api_key[-4:]
        return asdict(replace(self, api_key=key))

    def can_suggest(self) -> bool:
        return self.review and bool(self.api_key)


def read_settings(spark: SparkSession, path: str) -> Settings:
    return Settings.merged(json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()) or "{}"))


def write_settings(spark: SparkSession, settings: Settings, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(settings)),)], "value string").coalesce(1).write.mode("overwrite").text(path)
