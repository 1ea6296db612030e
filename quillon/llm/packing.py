"""Packing documents into training sequences by lexical retrieval.

A document is its token ids and an end mark.  Every full window of its own is a
sequence already; what remains of it, its tail, is packed with the tails of
documents like it.  Tails are dealt to shards of bounded size, with like ones (by two
minimum hashes of their ids) next to each other.  A shard has an inverted index with
BM25 weights; a seed's unused neighbours come out of it best first and fill the seed's
window, the last one cut where the window ends, and its rest is the next seed.  So no
sequence but a shard's last is padded, and each id lies in exactly one piece.

Document frequencies, the number of tails and their mean length, which BM25 weighs
terms by, are counted over all tails of the corpus, not by shard.

Scale.  Texts are read and tokenised once; full windows leave at once as a checksum,
only tails (under one window each) are stored and shuffled, two bytes an id where the
vocabulary allows.  Tails are range partitioned by hash and id into as many partitions as the
session shuffles into, sorted inside a partition, and cut into shards of ``SHARD`` tails there,
so a group of a million equal tails fills many shards, and a task that runs again packs alike.
The driver sees one count for each entry of the vocabulary, and a sample of keys whose size
follows the number of partitions, not the corpus.

Cases.  A null text is an empty one: the end mark alone.  A null id is kept as null.
Repeated rows are packed as documents of their own.  Strings like ``<|endoftext|>``
inside a text are ordinary text.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.workers import small_batches, tidy
from quillon.storage import stash

#: Tokens of a sequence; tails of a shard; parameters of BM25; share of a shard's tails from which a term is dense.
WINDOW, SHARD, K1, B, DENSE, END = 1024, 2048, 1.2, 0.75, 0.03, 0

# Fixed value: how byte-level BPE of this kind splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def ordered_ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings to ids, if the file is plain byte-level BPE whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel"
    if not plain or before.get("add_prefix_space", True) or not before.get("use_regex", True) or model.get("dropout") or model.get("byte_fallback"):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if any(y <= x for x, y in zip(made, made[1:])) or len(set(made)) + 256 + len(special & set(model["vocab"])) != len(model["vocab"]):
        return None
    names = _byte_names()
    return {bytes(names[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to the ids that the tokenizer in ``path`` gives, without special tokens.

    Where the file allows, its merges are run by a faster engine with equal ids.
    """
    ranks = ordered_ranks(path)
    if ranks is not None:
        import tiktoken

        fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda text: fast.encode_to_numpy(text, disallowed_special=())
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def checksum(ids: np.ndarray) -> int:
    return crc32(ids.astype("<u4").tobytes())


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    """A hash of small integers (multiply and shift)."""
    x = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)


_CUT = "key string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, near long, nearer long, ids binary"


def _cut(path: str, window: int):
    """Documents (key, text) to full windows and tails."""

    names = [c.split(" ")[0] for c in _CUT.split(", ")]
    kinds = pa.schema([(n, {"key": pa.string(), "ids": pa.binary()}.get(n, pa.int64())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, made, out = encoder(path), TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text")):  # one text at a time becomes a Python string
                key, ids = key.as_py(), np.append(encode(text.as_py()), np.uint32(END))
                n = len(ids)
                for a in range(0, n - window + 1, window):
                    out.append((key, a, window, checksum(ids[a : a + window]), n, part << 33 | made << 1, 0, 0, None))
                    made += 1
                if n % window:
                    tail = ids[n - n % window :]
                    terms = np.unique(tail)
                    near, nearer = int(_mixed(terms, 1).min()), int(_mixed(terms, 2).min())
                    out.append((key, n - len(tail), len(tail), 0, n, -1, near, nearer, tail.astype("<u4" if terms[-1] > 65535 else "<u2").tobytes()))
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return tidy(run)


def _ids(data: bytes, length: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * length else "<u4")


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tails with each id, in a partition; -1 and -2 count tails and their ids."""
    df = np.zeros(1 << 16, dtype=np.int64)
    n = total = 0
    for batch in batches:
        for data, length in zip(batch["ids"], batch["length"]):
            terms = np.unique(_ids(data, length))
            if terms[-1] >= len(df):
                df = np.concatenate([df, np.zeros(int(terms[-1]) + 1, dtype=np.int64)])
            df[terms] += 1
            n += 1
            total += length
    seen = np.flatnonzero(df)
    yield pd.DataFrame({"id": [*seen.tolist(), -1, -2], "n": [*df[seen].tolist(), n, total]})


class Index:
    """BM25 over the tails of one shard; a query is one of them."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        own = [np.unique(t, return_counts=True) for t in tails]
        sizes = np.array([len(t) for t, _ in own])
        doc = np.repeat(np.arange(len(tails)), sizes)
        ids, term = np.unique(np.concatenate([t for t, _ in own]), return_inverse=True)
        tf = np.concatenate([c for _, c in own]).astype(np.float32)
        lengths = np.array([len(t) for t in tails], dtype=np.float32)
        weight = idf[ids[term]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
        n_docs = np.bincount(term, minlength=len(ids))
        dense = n_docs > DENSE * len(tails)
        # dense terms as a matrix, the others as postings
        column = np.cumsum(dense) - 1
        is_dense = dense[term]
        table = np.zeros((len(tails), int(dense.sum())), dtype=np.float32)
        table[doc[is_dense], column[term[is_dense]]] = weight[is_dense]
        self.both = table @ (table > 0).T.astype(np.float32)  # document x query
        doc, term, weight = doc[~is_dense], term[~is_dense], weight[~is_dense].astype(np.float32)
        self.query_ends = np.cumsum(np.bincount(doc, minlength=len(tails)))
        self.query_terms = term
        order = np.argsort(term, kind="stable")
        self.posted, self.weight = doc[order], weight[order]
        self.ends = np.cumsum(np.bincount(term, minlength=len(ids)))
        self.n = len(tails)

    def scores(self, query: int) -> np.ndarray:
        """The score of every tail for the terms of tail ``query``."""
        terms = self.query_terms[self.query_ends[query - 1] if query else 0 : self.query_ends[query]]
        starts = np.where(terms > 0, self.ends[terms - 1], 0)
        sizes = self.ends[terms] - starts
        at = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        return self.both[:, query] + np.bincount(self.posted[at], self.weight[at], minlength=self.n)


def fill(tails: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (tail, start in it, length); each is full but the last."""
    index, free = Index(tails, idf, mean), np.ones(len(tails), dtype=bool)
    first, rest = 0, None
    while True:
        if rest is None:
            while first < len(tails) and not free[first]:
                first += 1
            if first == len(tails):
                return
            free[first] = False
            rest = (first, 0)
        scores, room, pieces = None, window, []
        while True:
            tail, start = rest
            take = min(room, len(tails[tail]) - start)
            pieces.append((tail, start, take))
            room -= take
            rest = (tail, start + take) if start + take < len(tails[tail]) else None
            if not room:
                break
            if scores is None:
                scores = np.where(free, index.scores(tail), -1.0)
            best = int(scores.argmax())
            if scores[best] < 0:
                break
            scores[best], free[best] = -1.0, False
            rest = (best, 0)
        yield pieces


_PIECE = "key string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(shipped, window: int, shard: int):
    """Tails of a shard to pieces."""

    def part_of(rows: pd.DataFrame, base: int, made: int) -> tuple[pd.DataFrame, int]:
        idf, mean = shipped.value
        tails = [_ids(d, n) for d, n in zip(rows["ids"], rows["length"])]
        keys, starts, totals = rows["key"].tolist(), rows["start"].tolist(), rows["doc_tokens"].tolist()
        out = []
        for pieces in fill(tails, idf, mean, window):
            offset = 0
            for t, a, n in pieces:
                out.append((keys[t], starts[t] + a, n, checksum(tails[t][a : a + n]), totals[t], base | made << 1 | 1, offset))
                offset += n
            made += 1
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in _PIECE.split(", ")]), made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made, rest = TaskContext.get().partitionId() << 33, 0, None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            while len(rest) >= 2 * shard:
                out, made = part_of(rest.iloc[:shard], base, made)
                rest = rest.iloc[shard:]
                yield out
        if rest is not None and len(rest):
            half = len(rest) if len(rest) <= shard * 5 // 4 else (len(rest) + 1) // 2
            for a in range(0, len(rest), half):
                out, made = part_of(rest.iloc[a : a + half], base, made)
                yield out

    return tidy(run)


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    spark, kind = docs.sparkSession, docs.schema[id].dataType
    small_batches(spark)
    rows = docs.select(F.col(id).cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = stash(rows.mapInArrow(_cut(tokenizer, window), _CUT))
    tails = cut.filter("sequence_id < 0")
    counts = dict(tails.select("ids", "length").mapInPandas(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n")).collect())
    n, total = counts.pop(-1, 0), counts.pop(-2, 0)
    idf = np.zeros(max(counts, default=0) + 1, dtype=np.float32)
    for term, df in counts.items():
        idf[term] = np.log1p((n - df + 0.5) / (df + 0.5))
    shipped = spark.sparkContext.broadcast((idf, total / max(1, n)))
    order = ["near", "nearer", "key", "start", "length", "ids"]
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // shard + 1)  # few tails make one shard
    dealt = tails.repartitionByRange(parts, *order[:3]).sortWithinPartitions(*order)
    packed = dealt.select("key", "start", "length", "doc_tokens", "ids").mapInPandas(_pack(shipped, window, shard), _PIECE)
    full = cut.filter("sequence_id >= 0").select("key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed).select(F.col("key").cast(kind).alias(id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
