import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
FAST = packing.encoder(PATH)


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=200))
def test_ids_are_the_tokenizers(text):
    assert list(FAST(text)) == PLAIN.encode(text, add_special_tokens=False).ids


def test_special_strings_and_long_words():
    for text in ("<|endoftext|>", "a<|endoftext|>b", "x" * 5000, "é" * 3000, "  \n\n \t a  ", "don't  STOP 123456"):
        assert list(FAST(text)) == PLAIN.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_run_as_they_are():
    other = public_tokenizers.path("word_bpe_49k.json")
    assert packing.ordered_ranks(other) is None
    assert list(packing.encoder(other)("Some words")) == Tokenizer.from_file(other).encode("Some words", add_special_tokens=False).ids


def checked(pieces, texts, window):
    """Every id in one piece, checksums, offsets without gaps; returns the lengths of sequences."""
    for key in {k for k, _ in texts}:
        ids = [np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, 0]) for k, t in texts if k == key]
        own = sorted((p for p in pieces if p.doc_id == key), key=lambda p: p.start)
        if len(ids) == 1:
            assert [p.start for p in own] == list(np.cumsum([0, *(p.length for p in own)])[:-1])
        assert sum(p.length for p in own) == sum(map(len, ids))
        for p in own:
            assert any(p.doc_tokens == len(x) and packing.checksum(x[p.start : p.start + p.length]) == p.ids_crc32 for x in ids)
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0) and p.length > 0
        sequences[p.sequence_id] = p.offset + p.length
    assert max(sequences.values(), default=0) <= window
    return list(sequences.values())


def test_pieces(spark, docs):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"word{x}" for x in rng.integers(0, 300, n)) for n in rng.integers(1, 900, 60)]
    rows = list(enumerate([*texts, None, "", "<|endoftext|>", "y" * 20_000]))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS key", "2 AS ids")
    lengths = checked(packing.pack(df, PATH).collect(), rows, 1024)
    assert sum(n < 1024 for n in lengths) <= 4  # one for each shard at most


@pytest.mark.parametrize("shard", [4, 2048])
def test_small_windows_and_shards(spark, shard):
    rows = [(i, f"number {i} of {i % 3} " * (i % 7)) for i in range(50)] + [(None, "no id"), (7, "twice"), (8, "twice"), (8, "twice")]
    checked(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, window=16, shard=shard).collect(), rows, 16)


def test_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def slow_bm25(tails, idf, mean, query):
    terms = set(tails[query].tolist())
    out = []
    for t in tails:
        tf = Counter(t.tolist())
        out.append(sum(idf[w] * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in terms if w in tf))
    return out


def test_scores_are_bm25():
    rng = np.random.default_rng(4)
    tails = [np.array(rng.zipf(1.3, n) % 500, dtype=np.uint32) for n in rng.integers(3, 60, 80)]
    idf = rng.random(500).astype(np.float32)
    index = packing.Index(tails, idf, 30.0)
    for q in (0, 17, 79):
        assert index.scores(q) == pytest.approx(slow_bm25(tails, idf, 30.0, q), rel=1e-4)


def test_best_neighbour_comes_first():
    tails = [np.array(x, dtype=np.uint32) for x in ([1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 5])]
    idf = np.ones(10, dtype=np.float32)
    assert list(packing.fill(tails, idf, 3.0, window=6)) == [[(0, 0, 3), (2, 0, 3)], [(1, 0, 3), (3, 0, 3)]]
    assert list(packing.fill(tails, idf, 3.0, window=5)) == [[(0, 0, 3), (2, 0, 2)], [(2, 2, 1), (1, 0, 3), (3, 0, 1)], [(3, 1, 2)]]


def test_frequencies_cover_all_tails(spark):
    """A term's weight comes from the corpus, not from its shard."""
    import pandas as pd

    frame = pd.DataFrame({"ids": [np.array([5, 5, 6], dtype="<u2").tobytes(), np.array([5, 70_000], dtype="<u4").tobytes()], "length": [3, 2]})
    got = next(packing._frequencies(iter([frame])))
    assert dict(zip(got["id"], got["n"])) == {5: 2, 6: 1, 70_000: 1, -1: 2, -2: 5}
    assert json.load(open(PATH))["model"]["type"] == "BPE"
