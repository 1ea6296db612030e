"""Language identification of mixed-language text.

Training counts, per language, the hashed character trigrams of words and the
scripts of their letters over a sample of labelled documents.  A word's script
(from fixed ranges of code points) narrows the languages that it may be in; its
trigrams give each of them a log-likelihood; and a Viterbi pass over the words of
a document, with a penalty for every switch of language, labels spans.  A
document's language is the one with most letters, its score their share.

Scale.  Training reads at most about ``rows_per_language`` documents of each
language (a documented bound, drawn by a hash of the text) and brings a table of
at most ``GRAMS`` counts per language to the driver; that model, of proven size, is
shipped to the workers.  Prediction is one pass over whole texts without a shuffle.
The Viterbi pass runs over many documents at once, in arrays of bounded size; a text too
long for one goes through in parts and keeps, of each word, a bit for each language.

Cases.  A text that is null or has no letters is ``und`` with score 0 and no spans; numerals
such as superscripts are no letters, but a word may hold them.  Up to 32,767 languages.
Letters in a script that no language was seen in leave all languages as candidates.
Ties go to the first language by code point.  Labels that are null are not learned
from; with no labelled text at all every text is ``und``.  Repeated rows get equal
answers.  An empty table gives an empty result.  Other columns are kept.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.workers import release, small_batches

#: Buckets of trigrams; cost of a switch (nats); least share of a script to count as a language's; words remembered by a worker.
GRAMS, SWITCH, SCRIPT_SHARE, MEMORY = 1 << 15, 8.0, 0.01, 200_000
#: Words times languages in one Viterbi array.
CELLS = 2_000_000


def _marks() -> str:
    """The combining marks (vowel signs and the like) as ranges of a character class."""
    runs: list[list[int]] = []
    for code in range(0x300, sys.maxunicode + 1):
        if unicodedata.category(chr(code)) in ("Mn", "Mc"):
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


#: A letter (or numeral that is no digit) and what follows without a gap: more of them, and marks on them.
WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_marks()}])*")

# First code points of runs of one script, and the script.
SCRIPTS = (
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"),
    (0x0B80, "Tamil"),
    (0x0C00, "Telugu"),
    (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"),
    (0x0E00, "Thai"),
    (0x0E80, "Lao"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Ethiopic"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Other"),
    (0x3400, "Han"),
    (0xA000, "Other"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"),
    (0xFF00, "Other"),
    (0x20000, "Han"),
)
_FIRST = [a for a, _ in SCRIPTS]


def script(word: str) -> str:
    """The script of a word's first letter."""
    return SCRIPTS[bisect_right(_FIRST, ord(word[0])) - 1][1]


def grams(word: str) -> list[int]:
    """Buckets of the trigrams of a lower-cased word between its ends."""
    w = f"\x02{word}\x03"
    return [crc32(w[i : i + 3].encode("utf-8", "surrogatepass")) & (GRAMS - 1) for i in range(len(w) - 2)]


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # GRAMS x languages
    scripts: dict[str, np.ndarray]  # 0 for candidates, a large negative number for others

    def score(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods, words x languages."""
        if not words:
            return np.zeros((0, len(self.langs)), dtype=np.float32)
        flat: list[int] = []
        starts = []
        for w in words:
            starts.append(len(flat))
            flat += grams(w)
        out = np.add.reduceat(self.logp[flat], starts, axis=0)
        free = np.zeros(len(self.langs), dtype=np.float32)
        return out + np.array([self.scripts.get(script(w), free) for w in words], dtype=np.float32)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (language, kind, item) of a partition: trigram buckets and scripts."""
    found: Counter = Counter()
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            words: Counter = Counter()
            for t in texts:
                words.update(WORD.findall(t.lower()))
            for w, n in words.items():
                found[lang, script(w)] += n * len(w)
                for g in grams(w):
                    found[lang, str(g)] += n
    if found:
        yield pd.DataFrame([(lang, item, n) for (lang, item), n in found.items()], columns=["lang", "item", "n"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = 3000) -> Model:
    """Learn from the rows of ``labelled`` with a language and a text."""
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = dict(rows.groupBy("lang").count().collect())
    share = F.lit(1.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, min(1.0, rows_per_language / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 20)) / float(1 << 20)
    counts = rows.filter(draw < share).mapInPandas(_count, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    place = {name: i for i, name in enumerate(langs)}
    table = np.full((GRAMS, max(1, len(langs))), 0.5)
    letters: dict[str, np.ndarray] = {}
    for name, item, n in counts.toLocalIterator():  # at most GRAMS + scripts rows for each language
        if item.isdigit():
            table[int(item), place[name]] += n
        else:
            letters.setdefault(item, np.zeros(len(langs)))[place[name]] += n
    logp = np.log(table / table.sum(axis=0)).astype(np.float32)
    everything = sum(letters.values(), np.zeros(max(1, len(langs))))
    scripts = {s: np.where(v / np.maximum(everything, 1) >= SCRIPT_SHARE, 0.0, -1e4).astype(np.float32) for s, v in letters.items()}
    return Model(langs, logp, {s: v for s, v in scripts.items() if (v == 0).any()})


def viterbi_long(ids: np.ndarray, table: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of one document, words given as rows of ``table``; scores are looked up part by part."""
    width, n = table.shape[1], len(ids)
    some = max(1, CELLS // width)
    best, stays = np.zeros(n, dtype=np.int16), []
    v = np.zeros(width, dtype=np.float32)
    for at in range(0, n, some):
        s = table[ids[at : at + some]]
        stay = np.ones(s.shape, dtype=bool)
        for t in range(len(s)):
            if at + t:
                top = v.max() - np.float32(switch)
                np.greater_equal(v, top, out=stay[t])
                v = np.maximum(v, top)
            v = v + s[t]
            best[at + t] = v.argmax()
            if not t % 1024:
                v = v - v.max()  # only differences count; sums of single precision stay small
        stays.append(np.packbits(stay, axis=1))
    label = best.copy()
    for at in range((n - 1) // some * some, -1, -some):
        stay = np.unpackbits(stays.pop(), axis=1, count=width)
        for t in range(len(stay) - 1, -1, -1):
            if at + t:
                label[at + t - 1] = label[at + t] if stay[t, label[at + t]] else best[at + t - 1]
    return label


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best label of each word of each document; documents are padded in blocks of like length."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int16)] * len(scores)
    order = sorted((i for i, s in enumerate(scores) if len(s)), key=lambda i: len(scores[i]))
    at = 0
    while at < len(order):
        width, to = scores[order[at]].shape[1], at
        while to < len(order) and (to == at or to - at < 512 and (to - at + 1) * len(scores[order[to]]) * width <= CELLS):
            to += 1
        some = order[at:to]
        steps, n = len(scores[some[-1]]), len(some)
        s = np.zeros((steps, n, width), dtype=np.float32)
        for k, i in enumerate(some):
            s[: len(scores[i]), k] = scores[i]
        best, stay = np.zeros((steps, n), dtype=np.int16), np.ones((steps, n, width), dtype=bool)
        v = s[0].copy()
        best[0] = v.argmax(axis=1)
        for t in range(1, steps):
            top = v.max(axis=1, keepdims=True) - np.float32(switch)
            np.greater_equal(v, top, out=stay[t])
            v = np.maximum(v, top)
            v += s[t]
            best[t] = v.argmax(axis=1)
        label = np.zeros((steps, n), dtype=np.int16)
        cols = np.arange(n)
        label[-1] = best[-1]
        for t in range(steps - 1, 0, -1):
            label[t - 1] = np.where(stay[t, cols, label[t]], label[t], best[t - 1])
        for k, i in enumerate(some):
            # padding scores are 0, so the label there is that of the last word or a tie of it
            out[i] = label[: len(scores[i]), k]
        at = to
    return out


class Labeller:
    """Labels words of texts; remembers words that it has scored."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)), dtype=np.float32)

    def __call__(self, words: list[list[str]]) -> list[np.ndarray]:
        if len(self.ids) > MEMORY:
            self._forget()
        ids, new = self.ids, []
        for doc in words:
            for w in set(doc).difference(ids):
                ids[w] = len(ids)
                new.append(w)
        self.table = np.concatenate([self.table, self.model.score(new)])
        rows = [np.fromiter(map(ids.__getitem__, doc), dtype=np.int64, count=len(doc)) for doc in words]
        long = [len(r) * self.table.shape[1] > CELLS for r in rows]
        short = iter(viterbi([self.table[r] for r, is_long in zip(rows, long) if not is_long]))
        return [viterbi_long(r, self.table) if is_long else next(short) for r, is_long in zip(rows, long)]


def _pieces(texts: pd.Series, chars: int = 2_000_000) -> Iterator[list[str]]:
    """Whole texts in lists of about ``chars`` characters."""
    some, n = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        some.append(t)
        n += len(t)
        if n >= chars:
            yield some
            some, n = [], 0
    if some:
        yield some


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``; columns of those names are replaced."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        labeller = Labeller(m)
        for batch in batches:
            rows = []
            for some in _pieces(batch):
                words = [WORD.findall(t.lower()) if m.langs else [] for t in some]
                for doc, labels in zip(words, labeller(words) if m.langs else [None] * len(words)):
                    if not any(c.isalpha() for w in doc for c in w):  # none, or numerals such as superscripts
                        rows.append(("und", 0.0))
                        continue
                    letters = np.bincount(labels, weights=np.fromiter(map(len, doc), dtype=np.float64, count=len(doc)), minlength=len(m.langs))
                    rows.append((m.langs[int(letters.argmax())], float(letters.max() / letters.sum())))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])
        release()

    return _with_struct(docs, of(F.col(text)), ["lang_pred", "score"])


def label_spans(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``spans``: array of (start, end, lang) in characters of the text, from first to last letter of each run of words."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:int,end:int,lang:string>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shipped.value
        labeller = Labeller(m)
        for batch in batches:
            out = []
            for some in _pieces(batch):
                found = [list(WORD.finditer(t)) if m.langs else [] for t in some]
                words = [[x.group().lower() for x in f] for f in found]
                for f, labels in zip(found, labeller(words) if m.langs else [()] * len(words)):
                    runs: list[dict] = []
                    for x, k in zip(f, labels):
                        if runs and runs[-1]["lang"] == m.langs[k]:
                            runs[-1]["end"] = x.end()
                        else:
                            runs.append({"start": x.start(), "end": x.end(), "lang": m.langs[k]})
                    out.append(runs)
            yield pd.Series(out)

    return docs.withColumn("spans", of(F.col(text)))


def _with_struct(docs: DataFrame, struct: Column, names: list[str]) -> DataFrame:
    kept = [c for c in docs.columns if c not in names]
    return docs.withColumn("__found", struct).select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"__found.{n}").alias(n) for n in names])


def held_out(id: Column) -> Column:
    """Documents that nothing may be learned from."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def predict(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from documents that are not held out, and predict all: id, held_out, lang_pred, score."""
    model = train(docs.filter(~held_out(F.col(id))), text, lang)
    found = identify(docs.select(F.col(id), F.col(text).alias("__text")), model, "__text")
    return found.select(id, held_out(F.col(id)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """The documents with a language that owns at least ``least`` of their letters, with all their columns."""
    model = train(docs.filter(~held_out(F.col(id))), text, lang)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    found = identify(docs.select(*kept, F.col(text).alias("__text")).withColumnsRenamed({c: f"__in_{c}" for c in docs.columns}), model, "__text")
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*[F.col(f"`__in_{c}`").alias(c) for c in docs.columns])
