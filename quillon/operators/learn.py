"""Learning to rank candidates, and calibrated confidence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import similarity
from quillon.operators.index import top_k
from quillon.rules import tables as T
from quillon.storage import discard, stash

#: Rows of a block of pairwise ranking.
BLOCK = 2048


def feature_columns(q: Column, norm: Column) -> dict[str, Column]:
    """The ranker's features of a pair that has the catalog's columns, the rule score and the similarities."""
    c = F.col
    desc = c("desc")
    tokens = F.split(norm, " ")
    generic = F.when(q["generic_procedure"].isNull(), 0.0).otherwise(similarity.generic_procedure_score(q["generic_procedure"], desc) / 150.0)
    known = F.coalesce(c("alias_tokens"), F.array().cast("array<string>"))
    return {
        "rule_score": c("score").cast("double"),
        "text_sim_char": F.coalesce(c("char_sim"), F.lit(0.0)),
        "text_sim_word": F.coalesce(c("word_sim"), F.lit(0.0)),
        "embed_sim": F.coalesce(c("embed_sim"), F.lit(0.0)),
        "modality_match": F.coalesce((q["modality"] == c("modality")).cast("double"), F.lit(0.0)),
        "view_match": similarity.view_match(q["views"], c("views"), c("least_views")),
        "contrast_match": similarity.contrast_match(q["contrast"], c("contrast")),
        "laterality_match": similarity.laterality_match(q["laterality"], c("laterality")),
        "body_overlap": F.when(F.size(c("regions")) > 0, similarity.coverage(q["body_parts"], c("regions"))).otherwise(0.0),
        "token_overlap_jacc": similarity.jaccard(tokens, c("tokens")),
        "fuzzy_ratio": similarity.fuzzy(norm, desc),
        "norm_edit_distance": similarity.edit_distance(norm, desc),
        "proc_keyword_score": similarity.procedure_score(q["procedure_keywords"], desc),
        "generic_proc_score": generic,
        "alias_overlap": similarity.coverage(known, tokens),
        "code_n_train": similarity.log_popularity(c("n_train")),
        "is_exact_prefix": similarity.is_prefix(norm, desc),
    }


def legacy_columns(q: Column, norm: Column) -> dict[str, Column]:
    """The older model's features of a pair: similarities, attributes, lengths and overlaps."""
    c = F.col
    desc, parts, tokens = c("desc"), q["body_parts"], F.split(norm, " ")
    views = F.when(q["views"].isNull(), 0.0).when(q["views"] == c("views"), 1.0).otherwise(-1.0)
    ranker = feature_columns(q, norm)
    own = {
        "view_match": views,
        "body_overlap": F.when(F.size(c("regions")) > 0, similarity.coverage(parts, c("regions"))).otherwise(0.0),
        "query_length": F.length(norm).cast("double"),
        "code_length": F.length(desc).cast("double"),
        "length_ratio": F.length(norm) / F.greatest(F.length(desc), F.lit(1)),
        "knowledge_overlap": similarity.coverage(c("tokens"), q["knowledge_tokens"]),
        "weighted_overlap": similarity.weighted_overlap(F.array_distinct(tokens), c("tokens")),
        "abbreviation": similarity.abbreviation_score(norm, desc),
    }
    same = ("text_sim_char", "modality_match", "contrast_match", "laterality_match", "token_overlap_jacc", "is_exact_prefix", "norm_edit_distance", "proc_keyword_score", "alias_overlap", "text_sim_word")
    return {n: ranker[n] for n in same} | own | {"fuzzy_ratio": c("fuzzy")}


def legacy_features(pairs: DataFrame, q: str = "q", norm: str = "normalized") -> DataFrame:
    """Add the older model's feature columns (``l_...``) to rows of :func:`quillon.operators.score.score_pairs`."""
    made = legacy_columns(F.col(q), F.col(norm))
    return pairs.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"l_{n}") for n, c in made.items()])


def group_sizes(rows: DataFrame, query: str = "qid", label: str = "label") -> DataFrame:
    """(query, rows, positives) of the groups that a ranker is trained on."""
    return rows.groupBy(query).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("positives"))


def features(pairs: DataFrame, q: str = "q", norm: str = "normalized") -> DataFrame:
    """Add the feature columns, in their order; missing codes give zeros."""
    made = feature_columns(F.col(q), F.col(norm))
    return pairs.select("*", *[F.coalesce(made[n].cast("double"), F.lit(0.0)).alias(f"f_{n}") for n in T.FEATURES])


def negatives(pairs: DataFrame, query: str = "qid", code: str = "code", label: str = "label", most: int = T.NEGATIVES, seed: int = 42, first: Column | None = None) -> DataFrame:
    """Each query's positives and at most ``most`` others, drawn by a seeded hash; those where ``first`` holds come first."""
    draw = F.md5(F.concat_ws(":", F.col(query).cast("string"), F.col(code).cast("string"), F.lit(seed)).cast("binary"))
    others = top_k(pairs.filter(F.col(label) == 0), query, [*([] if first is None else [F.desc(first)]), draw.asc(), F.asc(code)], most, "__n").drop("__n")
    return pairs.filter(F.col(label) == 1).unionByName(others)


def hard_negatives(pairs: DataFrame, query: str, code: str, same_block: Column, is_gold: Column, sim: str = "sim", near: int = 20, most: int = 3) -> DataFrame:
    """Of each query's ``near`` most similar rows the first ``most`` that are wrong and in its block."""
    close = top_k(pairs, query, [F.desc(sim), F.asc(code)], near, "__near")
    return top_k(close.filter(same_block & ~is_gold), query, [F.asc("__near")], most, "pick").drop("__near")


def wrong_predictions(scored: DataFrame, query: str, code: str, is_gold: Column, score: str = "score", k: int = 3) -> DataFrame:
    """Of each query's first ``k`` rows those that are wrong: rank first, then filter."""
    return top_k(scored, query, [F.desc(score), F.asc(code)], k).filter(~is_gold)


def holdout(examples: DataFrame, id: str, share: float = 0.1, least: int = 50, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, held out): a seeded draw of ``share`` of the rows, ``least`` at least.

    A top-k of hashes gives the bound; the split itself is a filter.
    """
    n = examples.count()
    draw = F.struct(F.md5(F.concat_ws(":", F.col(id).cast("string"), F.lit(seed)).cast("binary")), F.col(id))
    size = min(n, max(least, int(share * n)))
    last = examples.select(draw.alias("d")).orderBy("d").limit(size).agg(F.max("d").alias("__last"))
    marked = examples.join(F.broadcast(last)).withColumn("__out", F.coalesce(draw <= F.col("__last"), F.lit(False))).drop("__last")
    return marked.filter("NOT __out").drop("__out"), marked.filter("__out").drop("__out")


@dataclass
class Ranker:
    """A linear ranker over features, and the calibration of its margin."""

    weights: list[float]
    names: list[str]
    calibration: IsotonicRegressionModel | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        """Write weights and calibration under ``path``."""
        rows = list(enumerate(zip(self.names, self.weights)))
        frame = spark.createDataFrame([(i, n, float(w)) for i, (n, w) in rows], "ix int, name string, weight double")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
        if self.calibration is not None:
            self.calibration.write().overwrite().save(f"{path}/calibration")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ranker:
        rows = spark.read.parquet(f"{path}/weights").orderBy("ix").collect()  # a row for each feature
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/calibration")
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        return cls([r.weight for r in rows], [r.name for r in rows], IsotonicRegressionModel.load(f"{path}/calibration") if there else None)

    def score(self, rows: DataFrame, name: str = "raw") -> DataFrame:
        return rows.withColumn(name, sum((F.col(c) * w for c, w in zip(self.names, self.weights)), F.lit(0.0)))

    def confidence(self, margins: DataFrame, name: str = "calibrated_confidence") -> DataFrame:
        """Probability that the first row is right, from ``margin``; null without a calibration."""
        if self.calibration is None:
            return margins.withColumn(name, F.lit(None).cast("double"))
        out = self.calibration.transform(margins.withColumn("features", F.col("margin").cast("double")))
        return out.withColumn(name, F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("features", "prediction")


def _packed(rows: DataFrame, names: list[str], query: str) -> DataFrame:
    """(query, x): blocks of about ``BLOCK`` rows of a query, the features of all rows in one array."""
    sizes = rows.groupBy(query).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("__parts"))
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])
    dealt = rows.join(sizes, query).select(query, x.alias("x"), F.floor(F.rand(42) * F.col("__parts")).cast("int").alias("c"))
    return dealt.groupBy(query, "c").agg(F.flatten(F.collect_list("x")).alias("x")).drop("c")


def _sums(work, k: int):
    """``work`` of each block of pairs to an array of sums, one row for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for batch in batches:
            for g, b in zip(batch["g"], batch["b"]):
                total = total + work(np.asarray(g).reshape(-1, k), np.asarray(b).reshape(-1, k))
        if not np.isscalar(total):
            yield pd.DataFrame({"s": [total.tolist()]})

    return run


def _total(blocks: DataFrame, work, k: int) -> np.ndarray:
    """Sums over all blocks; a small array from each task comes to the driver."""
    return np.sum([np.array(r.s) for r in blocks.mapInPandas(_sums(work, k), "s array<double>").collect()], axis=0)


def _squares(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs, and the sums of squares of their differences."""
    mid = b.mean(axis=0)
    g, b = g - mid, b - mid
    return np.concatenate([[len(g) * len(b)], len(b) * (g * g).sum(axis=0) - 2 * g.sum(axis=0) * b.sum(axis=0) + len(g) * (b * b).sum(axis=0)])


def _newton(u: np.ndarray, scale: np.ndarray):
    """Loss, gradient and curvature at the weights ``u`` of the differences over ``scale``."""

    def work(g: np.ndarray, b: np.ndarray) -> np.ndarray:
        mid = b.mean(axis=0)
        g, b = (g - mid) * scale, (b - mid) * scale
        m = (g @ u)[:, None] - (b @ u)
        e = np.exp(-np.abs(m))
        loss = (np.log1p(e) - np.minimum(m, 0.0)).sum()
        p = np.where(m > 0, e, 1.0) / (1.0 + e)
        r = e / (1.0 + e) ** 2
        slope = -(p.sum(axis=1) @ g) + p.sum(axis=0) @ b
        mixed = g.T @ (r @ b)
        bend = (g.T * r.sum(axis=1)) @ g + (b.T * r.sum(axis=0)) @ b - mixed - mixed.T
        return np.concatenate([[loss], slope, bend.ravel()])

    return work


def fit_ranker(rows: DataFrame, names: list[str], query: str = "qid", label: str = "label", iterations: int = 50, penalty: float = 1e-3) -> Ranker:
    """Pairwise logistic ranking: within a query, differences of a right and a wrong row.

    The mean logistic loss of all differences, each divided by its column's deviation, and half
    of ``penalty`` times the weights' squares, is minimised by Newton's method.  The differences
    are never written out: a query's right and wrong rows meet in blocks of ``BLOCK`` rows, and
    only sums leave a block.
    """
    k = len(names)
    good, bad = (_packed(rows.filter(F.col(label) == x), names, query).withColumnRenamed("x", c) for x, c in ((1, "g"), (0, "b")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stash(good.join(bad, query).select("g", "b").repartition(parts))
    if blocks.isEmpty():
        raise ValueError("no query has a right and a wrong row")
    sums = _total(blocks, _squares, k)
    pairs, spread = sums[0], np.sqrt(np.maximum(sums[1:], 0.0) * 2 / max(1.0, 2 * sums[0] - 1))
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1.0), 0.0)

    def at(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = _total(blocks, _newton(u, scale), k) / pairs
        return s[0] + penalty / 2 * u @ u, s[1 : k + 1] + penalty * u, s[k + 1 :].reshape(k, k) + penalty * np.eye(k)

    u = np.zeros(k)
    loss, slope, bend = at(u)
    for _ in range(iterations):
        step = np.linalg.solve(bend, slope)
        if slope @ step < 1e-14:
            break
        size, after = 1.0, at(u - step)
        while after[0] > loss - 1e-4 * size * (slope @ step) and size > 1e-6:
            size /= 2
            after = at(u - size * step)
        if after[0] > loss:
            break
        u, (loss, slope, bend) = u - size * step, after
    discard(blocks)
    return Ranker((u * scale).tolist(), list(names))


@dataclass
class TreeRanker:
    """A ranker of boosted trees: a sum of regression trees over the features."""

    trees: list[PipelineModel]
    names: list[str]
    rate: float
    calibration: IsotonicRegressionModel | None = None

    def score(self, rows: DataFrame, name: str = "raw") -> DataFrame:
        out = rows.withColumn(name, F.lit(0.0))
        for tree in self.trees:
            out = tree.transform(out).withColumn(name, F.col(name) + self.rate * F.col("__step")).drop("__x", "__step")
        return out

    confidence = Ranker.confidence

    def save(self, spark: SparkSession, path: str) -> None:
        head = spark.createDataFrame([(len(self.trees), float(self.rate), list(self.names))], "trees int, rate double, names array<string>")
        head.coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
        for i, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree={i}")
        if self.calibration is not None:
            self.calibration.write().overwrite().save(f"{path}/calibration")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeRanker:
        head = spark.read.parquet(f"{path}/head").first()
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/calibration")
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        trees = [PipelineModel.load(f"{path}/tree={i}") for i in range(head.trees)]
        return cls(trees, list(head.names), head.rate, IsotonicRegressionModel.load(f"{path}/calibration") if there else None)


def lambdas(scored: DataFrame, query: str = "qid", label: str = "label", tie: str = "code", raw: str = "raw") -> DataFrame:
    """Add ``__slope`` and ``__curve``: what each row's score should change by, from pairs of a right and a wrong row.

    A pair weighs as much as exchanging its two places would change the discounted gain (labels 0 and 1).
    Pairs are of one query's sampled rows only.
    """
    place = F.row_number().over(W.partitionBy(query).orderBy(F.desc(raw), F.asc(tie)))
    rows = scored.select(query, tie, label, raw, (1 / F.log2(place + 1)).alias("gain"))
    best = F.sum(1 / F.log2(F.col("n") + 1))
    ideal = rows.filter(F.col(label) == 1).withColumn("n", F.row_number().over(W.partitionBy(query).orderBy(tie))).groupBy(query).agg(best.alias("ideal"))
    good = rows.filter(F.col(label) == 1).select(query, F.col(tie).alias("g"), F.col(raw).alias("gr"), F.col("gain").alias("gg"))
    bad = rows.filter(F.col(label) == 0).select(query, F.col(tie).alias("b"), F.col(raw).alias("br"), F.col("gain").alias("bg"))
    rho = 1 / (1 + F.exp(F.col("gr") - F.col("br")))
    pairs = good.join(bad, query).join(ideal, query).withColumn("d", F.abs(F.col("gg") - F.col("bg")) / F.col("ideal")).withColumn("rho", rho)
    push, bend = F.col("rho") * F.col("d"), F.col("rho") * (1 - F.col("rho")) * F.col("d")
    ends = F.array(F.struct(F.col("g").alias(tie), push.alias("s"), bend.alias("c")), F.struct(F.col("b").alias(tie), (-push).alias("s"), bend.alias("c")))
    sums = pairs.select(query, F.explode(ends).alias("e")).groupBy(query, F.col(f"e.{tie}").alias(tie)).agg(F.sum("e.s").alias("__slope"), F.sum("e.c").alias("__curve"))
    return scored.join(sums, [query, tie], "left").fillna(0.0, ["__slope", "__curve"])


def fit_tree_ranker(rows: DataFrame, names: list[str], query: str = "qid", label: str = "label", tie: str = "code", rounds: int = 20, depth: int = 4, rate: float = 0.3) -> TreeRanker:
    """List-wise ranking by boosted trees: each round fits a tree to the Newton step of the :func:`lambdas` and adds it."""
    from pyspark.ml import Pipeline

    ranker = TreeRanker([], list(names), rate)
    scored = rows.select(query, tie, label, *names).withColumn("raw", F.lit(0.0))
    for _ in range(rounds):
        aimed = lambdas(scored, query, label, tie).withColumn("__aim", F.col("__slope") / (F.col("__curve") + 1e-3)).withColumn("__w", F.col("__curve") + 1e-3)
        aimed = stash(aimed)
        stages = [
            VectorAssembler(inputCols=names, outputCol="__x"),
            DecisionTreeRegressor(featuresCol="__x", labelCol="__aim", weightCol="__w", predictionCol="__step", maxDepth=depth, minInstancesPerNode=3, seed=42),
        ]
        tree = Pipeline(stages=stages).fit(aimed)
        ranker.trees.append(tree)
        step = tree.transform(aimed).withColumn("raw", F.col("raw") + rate * F.col("__step"))
        scored = stash(step.select(query, tie, label, *names, "raw"))
        discard(aimed)
    return ranker


def scaled(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` with mean 0 and standard deviation 1, as the older model is fed."""
    data = VectorAssembler(inputCols=names, outputCol="__raw").transform(rows)
    out = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(data).transform(data)
    return out.withColumn("__x", vector_to_array("__x")).withColumns({n: F.col("__x")[i] for i, n in enumerate(names)}).drop("__raw", "__x")


def calibrate(ranker: Ranker, margins: DataFrame, least: int = 30) -> Ranker:
    """Fit ``margin`` to ``correct`` (0 or 1), given ``least`` examples at least."""
    if margins.count() >= least:
        data = margins.select(F.col("margin").cast("double").alias("features"), F.col("correct").cast("double").alias("label"))
        ranker.calibration = IsotonicRegression().fit(data)
    return ranker


def fit_forest(rows: DataFrame, names: list[str], label: str = "label", trees: int = 100, depth: int = 15, seed: int = 42) -> PipelineModel:
    """The older model: a balanced random forest on scaled features."""
    from pyspark.ml import Pipeline

    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.agg(F.count(F.lit(1)).alias("__all")).join(F.broadcast(sizes.agg(F.count(F.lit(1)).alias("__k"))))
    weighted = rows.join(F.broadcast(sizes), label).join(F.broadcast(total)).withColumn("__w", F.col("__all") / (F.col("__k") * F.col("__n")))
    stages = [
        VectorAssembler(inputCols=names, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True),
        RandomForestClassifier(featuresCol="__x", labelCol=label, weightCol="__w", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed),
    ]
    return Pipeline(stages=stages).fit(weighted.select(*names, label, "__w"))


def forest_scores(model: PipelineModel, rows: DataFrame, name: str = "proba") -> DataFrame:
    """Add the probability of the last class."""
    out = model.transform(rows)
    return out.withColumn(name, F.element_at(vector_to_array("probability"), -1)).drop("__raw", "__x", "rawPrediction", "probability", "prediction")

