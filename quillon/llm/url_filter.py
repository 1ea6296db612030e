"""URL rules behind a Bloom filter cascade.

A rule names a host (with all its subdomains) and a start of the path.  A URL's
candidate keys are its host's last labels joined with starts of its path, in the
few shapes that rules have.  Whether a candidate is a rule is answered by a
cascade of Bloom filters, without a join: level 1 holds the listed keys; level 2
holds the keys of the corpus that level 1 wrongly lets pass, level 3 the listed
keys that level 2 wrongly stops, and so on in turn until a level errs on none.
As the levels are built over all keys that occur in the corpus (its complete
universe), membership there is exact, not approximate.  A second cascade, whose
universe is the list itself, tells which of the rules block.

Scale.  The universe is a distinct over two or so short keys for each URL, with
map-side combining, so a hot host is counted once per task.  A level has as many
hashes as the logarithm of the number of keys that it must stop for each key that it
holds, so level 1 is expected to let no more wrong keys pass than there are rules, and
later levels are smaller in turn: sizes follow the list of rules, and the corpus only by
that logarithm.  A level is one row of words, which expressions read as a scalar
subquery: it is run once, sent with the tasks, and not written into the plan.  A list whose
level would exceed ``LEVEL_BITS`` is not broadcast but joined by key (:func:`_by_join`).

Of several rules the longest (host and path together) wins, then the later by code point.

Cases.  A null URL, or one without ``://``, has an empty host and path, no rule
and the default verdict.  Repeated URLs are judged alike.  A rule listed twice
counts once; listed with both verdicts it is an error.  Other columns are kept.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, log, log2
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.storage import stash

#: Least and most hashes of a level; most bits of one (64 MB).
LEAST_HASHES, MOST_HASHES, LEVEL_BITS = 3, 32, 1 << 29


class Rule(NamedTuple):
    """``host`` and its subdomains, paths that start with ``path``: ``block`` or ``allow``."""

    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """Lower-case (A-Z only) authority after the first ``://``; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the authority, without query and fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _shapes(rules: Sequence[Rule]) -> list[tuple[int, int]]:
    """Labels of the host and characters of the path."""
    return sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})


def _candidates(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> list[Column]:
    """One key for each shape; null where the URL is too short for it."""
    fits = lambda labels, chars: (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= chars) & (host != "")
    return [F.when(fits(n, m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m))) for n, m in shapes]


def _shape(n: int, against: int) -> tuple[int, int]:
    """Hashes and bits of a level that holds ``n`` keys and is to err on about ``n`` of ``against`` others."""
    hashes = min(MOST_HASHES, max(LEAST_HASHES, ceil(log2(max(1.0, against / max(1, n))))))
    return hashes, 64 * ceil(max(1, n) * hashes / log(2) / 64)


class Level(NamedTuple):
    """One Bloom filter: its place in the cascade, hashes, bits, and a table of one row with its words."""

    number: int
    hashes: int
    bits: int
    words: DataFrame

    def holds(self, key: Column) -> Column:
        words = self.words.scalar()
        hit = lambda p: F.getbit(F.element_at(words, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
        return reduce(Column.__and__, [hit(p) for p in _positions(key, self.number, self.hashes, self.bits)])


def _positions(key: Column, number: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(number), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def build_level(keys: DataFrame, number: int, n: int, against: int) -> Level:
    """Set the bits of ``n`` keys (column ``key``); the words are one row in the shared folder."""
    hashes, bits = _shape(n, against)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, hashes, bits))).alias("at"))
    set_ = at.select(F.shiftright("at", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    words = set_.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
    return Level(number, hashes, bits, stash(row))


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (both with a column ``key``; keys of both count once)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, others: int | None = None):
        """``others``: rows of ``universe``, if known."""
        self.levels: list[Level] = []
        encode = inside = listed.distinct()
        n, others = inside.count(), universe.count() if others is None else others
        against = universe
        while n:
            level = build_level(encode, len(self.levels), n, others)
            wrong = against.filter(level.holds(F.col("key")))
            if not self.levels:  # the universe also has listed keys; few keys come this far
                both = wrong.select("key", F.lit(0).alias("own")).unionByName(inside.select("key", F.lit(1).alias("own")))
                wrong = both.groupBy("key").agg(F.max("own").alias("own")).filter("own = 0").select("key")
            self.levels.append(level)
            wrong = stash(wrong.distinct())
            encode, against, others, n = wrong, encode, n, wrong.count()

    def holds(self, key: Column) -> Column:
        """True for listed keys; exact for keys of the universe and the list."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.holds(key), answer).otherwise(F.lit(level.number % 2 == 1))
        return answer


def _by_join(parts: DataFrame, keys: Column, listed: DataFrame) -> DataFrame:
    """Columns of ``parts`` with ``rule``, for lists too long for a level: candidates are joined with the list."""
    rows = stash(parts.withColumn("__row", F.monotonically_increasing_id()))
    met = rows.select("__row", F.explode(keys).alias("key")).join(listed.select("key"), "key")
    best = met.groupBy("__row").agg(F.max(F.struct(F.length("key").alias("n"), "key"))["key"].alias("rule"))
    return rows.join(best, "__row", "left").drop("__row")


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``; columns of those names are replaced."""
    spark = pages.sparkSession
    verdicts = {r.host + r.path: r.verdict for r in rules}
    if len(verdicts) != len(set(rules)):
        raise ValueError("a rule is listed with two verdicts")
    if set(verdicts.values()) - {"block", "allow"}:
        raise ValueError("a verdict is block or allow")
    shapes = _shapes(rules)
    parts = pages.select(*[pages[f"`{c}`"] for c in pages.columns if c not in ("host", "path", "rule", "verdict")], host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    if not rules:
        return parts.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    listed = stash(spark.createDataFrame(list(verdicts.items()), "key string, verdict string").coalesce(1))
    block = listed.filter("verdict = 'block'").select("key")
    candidates = _candidates(F.col("host"), F.col("path"), shapes)
    keys = F.array_distinct(F.array_compact(F.array(*candidates)))
    universe = stash(parts.select(F.explode(keys).alias("key")).distinct())
    size = universe.count()
    if max(_shape(len(verdicts), size)[1], _shape(len(verdicts), len(verdicts))[1]) > LEVEL_BITS:
        found = _by_join(parts, keys, listed).join(listed.select(F.col("key").alias("rule"), F.col("verdict").alias("__v")), "rule", "left")
        return found.select(*parts.columns, "rule", F.coalesce("__v", F.lit(default)).alias("verdict"))
    rule_keys, blocks = Cascade(listed.select("key"), universe, size), Cascade(block, listed.select("key"), len(verdicts))
    found = [F.when(k.isNotNull() & rule_keys.holds(k), F.struct(F.length(k).alias("n"), k.alias("key"))) for k in candidates]
    rule = F.greatest(*found, F.lit(None).cast("struct<n:int,key:string>"))["key"]
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocks.holds(F.col("rule")), "block").otherwise("allow")
    return parts.withColumn("rule", rule).withColumn("verdict", verdict)
