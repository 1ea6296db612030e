"""Toxicity by a classifier chain.

Categories are predicted one after the other.  Each has a linear model over its own
evidence (short character sequences that tell its documents apart, and a few measures
of style) and over the probabilities of all earlier categories.  So that a later model
meets earlier probabilities of the quality it will see in use, it is trained on
out-of-fold ones: predictions for documents by models that were fitted without them.

Training takes at most ``rows`` labelled documents, drawn by a hash, with half of the
places for positives of the last category as far as there are any; that bound is a
parameter.  Evidence is counted on the cluster and comes to the driver as at most
``GRAMS`` strings for each category; the design matrix has ``rows`` times that many
bits.  Prediction is one pass over whole texts with an Aho-Corasick automaton, without
a shuffle; the model that workers get is of that bounded size.

Cases.  A null text counts as empty; it is scored by its style alone.  Labels of
documents that don't exist, null labels and labels that repeat an id with another value
(the largest counts) do no harm.  A category without both classes in training gets its
rate as everyone's probability, 0 without any labels.  Repeated rows get equal answers.
A probability equal to the threshold counts as toxic; strings of equal evidence are chosen
by code point.  Long texts are read whole, each as one Python string.
An empty table gives an empty result.  Other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.workers import small_batches
from quillon.storage import stash

#: Strings of each category; documents at least with a string; folds; ridge; rounds of Newton's method.
GRAMS, LEAST, FOLDS, RIDGE, NEWTON = 192, 3, 4, 0.3, 12
ROWS = 6000
SPACE = re.compile(r"\s+")
STYLE = ("log_words", "upper", "digit", "punctuation", "non_ascii")


@dataclass(frozen=True)
class Category:
    """A category's name, and the label column and value that mark it."""

    name: str
    column: str
    value: int = 1


CATEGORIES = (Category("low_quality", "quality", 0), Category("toxic", "toxic", 1))


def clean(text: str | None) -> str:
    """Lower-cased, with single spaces and one at either end."""
    return f" {SPACE.sub(' ', text or '').strip().lower()} "


def grams(line: str) -> set[str]:
    """Sequences of four and five characters inside words, or at their ends."""
    out: set[str] = set()
    for w in set(line.split()):
        w = f" {w} "
        for n in (4, 5):
            out.update(w[i : i + n] for i in range(max(1, len(w) - n + 1)))
    return out


def style(text: str | None) -> list[float]:
    """Measures of the whole text: its length and shares of kinds of bytes."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = np.bincount(data, minlength=256)
    space = n[[9, 10, 11, 12, 13, 32]].sum()
    ink = max(1, len(data) - space)
    upper, lower, digit, high = n[65:91].sum(), n[97:123].sum(), n[48:58].sum(), n[128:].sum()
    return [np.log1p(space) / 10, upper / ink, digit / ink, (ink - upper - lower - digit - high) / ink, high / ink]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    if not len(y) or y.min() == y.max():
        w = np.zeros(x.shape[1])
        w[-1] = 30.0 if len(y) and y[0] else -30.0
        return w
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(NEWTON):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Chain:
    """Linear models in a row; later ones also see the probabilities of earlier ones."""

    def __init__(self, categories: Sequence[Category], strings: list[list[str]]):
        self.names = [c.name for c in categories]
        self.strings = sorted({s for own in strings for s in own})
        place = {s: i for i, s in enumerate(self.strings)}
        self.columns = [[place[s] for s in own] + [len(self.strings) + i for i in range(len(STYLE))] for own in strings]
        self.weights: list[np.ndarray] = []
        self._machine = None

    def design(self, texts: Sequence[str | None]) -> np.ndarray:
        """Which strings each whole text holds, and its style."""
        if self._machine is None and self.strings:
            self._machine = ahocorasick.Automaton()
            for i, s in enumerate(self.strings):
                self._machine.add_word(s, i)
            self._machine.make_automaton()
        x = np.zeros((len(texts), len(self.strings) + len(STYLE)), dtype=np.float32)
        for row, text in zip(x, texts):
            if self.strings:
                row[list({i for _, i in self._machine.iter(clean(text))})] = 1
            row[len(self.strings) :] = style(text)
        return x

    def train(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
        """``y``: a column for each category; ``fold``: the fold of each row."""
        earlier = np.zeros((len(x), 0))
        for k, own in enumerate(self.columns):
            at = np.hstack([x[:, own], earlier])
            unseen = np.zeros(len(x))
            for f in range(FOLDS):
                out = fold == f
                unseen[out] = sigmoid(np.hstack([at[out], np.ones((out.sum(), 1))]) @ fit(at[~out], y[~out, k]))
            self.weights.append(fit(at, y[:, k]))
            earlier = np.hstack([earlier, unseen[:, None]])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, documents x categories."""
        earlier = np.zeros((len(x), 0))
        for own, w in zip(self.columns, self.weights):
            p = sigmoid(np.hstack([x[:, own], earlier, np.ones((len(x), 1))]) @ w)
            earlier = np.hstack([earlier, p[:, None]])
        return earlier

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with each string, all and by category, in a partition."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, marks in zip(batch["text"], batch["marks"]):
            marks = np.array([1, *marks], dtype=np.int64)
            for g in grams(clean(text)):
                if g in found:
                    found[g] += marks
                else:
                    found[g] = marks.copy()
    if found:
        yield pd.DataFrame({"gram": list(found), "n": [v.tolist() for v in found.values()]})


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[Category] = CATEGORIES, id: str = "doc_id", text: str = "text", rows: int = ROWS) -> Chain:
    """Fit a chain on the labelled documents that fall into the sample."""
    known = labels.filter(F.col(id).isNotNull()).groupBy(id).agg(*[F.max(c).alias(c) for c in {c.column for c in categories}]).dropna()
    marks = F.array(*[(F.col(c.column) == c.value).cast("int") for c in categories])
    known = known.select(F.col(id).alias("__id"), marks.alias("marks"))
    last, draw = F.element_at("marks", -1), [F.xxhash64("__id", F.lit(3)), "__id"]
    halves = [known.filter(last == v).orderBy(*draw).limit(rows // 2) for v in (0, 1)]
    sample = stash(halves[0].unionByName(halves[1]))  # at most ``rows`` slim rows
    seen = stash(docs.join(F.broadcast(sample), docs[id] == sample["__id"]).select("__id", F.coalesce(docs[text], F.lit("")).alias("text"), "marks"))
    n, *totals = seen.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.col("marks")[k]), F.lit(0)) for k in range(len(categories))]).first()
    counts = seen.mapInPandas(_evidence, "gram string, n array<long>").groupBy("gram").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(len(categories) + 1)])
    counts = stash(counts.filter(F.col("n0") >= LEAST))
    strings = []
    for k, total in enumerate(totals, 1):
        if not 0 < total < n:
            strings.append([])
            continue
        rate, other = F.col(f"n{k}") / total, (F.col("n0") - F.col(f"n{k}")) / (n - total)
        pooled = F.col("n0") / n
        z = F.abs(rate - other) / F.sqrt(pooled * (1 - pooled) + 1e-6)
        strings.append([r["gram"] for r in counts.select("gram", z.alias("z")).orderBy(F.desc("z"), "gram").limit(GRAMS).collect()])
    chain = Chain(categories, strings)
    shipped = docs.sparkSession.sparkContext.broadcast(chain)

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = shipped.value.design(batch["text"].tolist())
            yield pd.DataFrame({"id": batch["__id"].astype(str), "x": [r.tobytes() for r in x], "y": batch["marks"].map(lambda m: bytes(m.astype("uint8")))})

    got = sorted(map(tuple, seen.mapInPandas(rows_of, "id string, x binary, y binary").collect()))
    width = len(chain.strings) + len(STYLE)
    x = np.array([np.frombuffer(r[1], dtype=np.float32) for r in got], dtype=np.float64).reshape(len(got), width)
    y = np.array([np.frombuffer(r[2], dtype=np.uint8) for r in got], dtype=np.float64).reshape(len(got), len(categories))
    chain.train(x, y, np.array([crc32(r[0].encode()) % FOLDS for r in got], dtype=np.int64))
    return chain


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Add a probability column ``p_<category>`` for each category; columns of those names are replaced."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            model, found = shipped.value, []
            for at in range(0, len(batch), 512):
                found.append(model.predict(model.design(batch.iloc[at : at + 512].tolist()).astype(np.float64)))
            yield pd.DataFrame(np.concatenate(found) if found else np.zeros((0, len(names))), columns=names)

    kept = [c for c in docs.columns if c not in names]
    return docs.withColumn("__p", of(F.col(text))).select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"__p.{n}").alias(n) for n in names])


def detect(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, the chain's probabilities, and ``toxic`` at the threshold."""
    chain = train(docs, labels, id=id, text=text)
    found = score(docs.select(F.col(id), F.col(text).alias("__text")), chain, "__text")
    return found.select(id, *[f"p_{n}" for n in chain.names], (F.col(f"p_{chain.names[-1]}") >= threshold).alias("toxic"))
