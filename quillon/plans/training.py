"""Training the ranker from mappings, and when to do so."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime, time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import learn, rank, score
from quillon.operators.sized import small
from quillon.plans.match import Matcher
from quillon.rules import tables as T
from quillon.storage import stash

#: Examples that training needs; of a held-out part, share and least number.
GATE, SHARE, LEAST = 100, 0.1, 50
#: Places of a seed ranker that are mined.
MINED = 5
NAMES = [f"f_{n}" for n in T.FEATURES]


def labelled_pairs(matcher: Matcher, examples: DataFrame, mined: DataFrame | None = None) -> DataFrame:
    """Candidates of each example (qid, query, gold) with features and ``label``.

    The gold code is among them, and so are the pairs (qid, code) of ``mined``, which are marked.
    """
    parsed = matcher.parsed(examples)
    pool = matcher.pairs(parsed)
    wanted = forced_pairs(examples, pool, mined)
    forced = wanted.join(parsed, "qid").join(small(matcher.catalog), "code").join(matcher.aliases, "code", "left").join(matcher.counts, "code", "left")
    rows = pool.unionByName(forced, allowMissingColumns=True)
    rows = rows.withColumn("mined", F.lit(False)) if mined is None else rows.join(mined.select("qid", "code", F.lit(True).alias("mined")), ["qid", "code"], "left").fillna(False, ["mined"])
    return learn.features(score.score_pairs(rows)).withColumn("label", (F.col("code") == F.col("gold")).cast("int"))


def forced_pairs(examples: DataFrame, pool: DataFrame, mined: DataFrame | None = None) -> DataFrame:
    """(qid, code) of gold and mined codes that the pool lacks."""
    gold = examples.select("qid", F.col("gold").alias("code"))
    wanted = gold if mined is None else gold.unionByName(mined.select("qid", "code")).distinct()
    return wanted.join(pool.select("qid", "code"), ["qid", "code"], "left_anti")


def mine(ranker: learn.Ranker, pairs: DataFrame, k: int = MINED) -> DataFrame:
    """(qid, code): wrong codes among the first ``k`` of a seed ranker."""
    return learn.wrong_predictions(ranker.score(pairs), "qid", "code", F.col("label") == 1, "raw", k).select("qid", "code")


def train(matcher: Matcher, examples: DataFrame, gate: int = GATE, fit_with: Callable = learn.fit_ranker, mining: bool = False) -> learn.Ranker | learn.TreeRanker | None:
    """A calibrated ranker from examples (qid, query, gold), or None with ``gate`` examples or fewer.

    ``fit_with``: :func:`learn.fit_ranker` (linear, pairwise) or :func:`learn.fit_tree_ranker` (boosted
    trees, list-wise).  With ``mining`` a first ranker's wrong predictions are among the
    negatives that the second one is trained on.
    """
    if examples.count() <= gate:
        return None
    fit, out = learn.holdout(examples, "qid", SHARE, LEAST)
    pairs = stash(labelled_pairs(matcher, fit).select("qid", "code", "label", *NAMES))
    rows = stash(learn.negatives(pairs))
    ranker = fit_with(rows, NAMES)
    if mining:
        again = labelled_pairs(matcher, fit, stash(mine(ranker, pairs))).select("qid", "code", "label", "mined", *NAMES)
        ranker = fit_with(stash(learn.negatives(again, first=F.col("mined"))), NAMES)
    held = stash(ranker.score(labelled_pairs(matcher, out)).select("qid", "code", "code_ix", "label", "raw"))
    first = rank.ranked(held, 1, score="raw").select("qid", F.col("label").alias("correct"))
    return learn.calibrate(ranker, rank.margin(held, score="raw").join(first, "qid"))


def examples_of(mappings: DataFrame) -> DataFrame:
    """Mappings as examples; repeated ones are kept."""
    return mappings.select(F.col("ix").alias("qid"), "query", F.col("code").alias("gold"))


# Stages of a start and the seconds that each is expected to take.
EXPECTED = (("start", 2), ("codes", 3), ("mappings", 2), ("tfidf", 3), ("model", 10), ("save", 12))


def status(spark: SparkSession, done: Sequence[str], elapsed: float = 0.0) -> DataFrame:
    """(stage, state, percent, seconds_left): how far a run is, by expected seconds; ``elapsed`` is of the stage under way."""
    total, past, rows, running = sum(s for _, s in EXPECTED), 0.0, [], False
    for stage, seconds in EXPECTED:
        if stage in done:
            part, state = float(seconds), "done"
        else:
            part, state = (min(elapsed, 0.95 * seconds), "running") if not running else (0.0, "waiting")
            running = True
        past += part
        rows.append((stage, state, round(100 * past / total, 1), float(seconds) - part))
    return spark.createDataFrame(rows, "stage string, state string, percent double, seconds_left double")


def due(now: datetime, at: str | None, last: date | None) -> bool:
    """Whether the daily run at ``HH:MM`` is due: its time is past and it has not run that day."""
    if not at:
        return False
    hour, _, minute = at.partition(":")
    try:
        start = time(int(hour), int(minute or 0))
    except ValueError:
        return False
    return now.time() >= start and last != now.date()

