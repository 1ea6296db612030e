import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import chat_format as chat
from quillon.llm import url_filter
from quillon.llm.queries import ODD_TEXT, URL_RULES


def judge(url, rules=URL_RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "://x", "http://EXAMPLE.com/en/712", "https://a.b.example.com/en/8?x=/en/7", "http://com/en/", "http://com/en",
    "http://example.net/de/81#a", "http://www.example.net/de/9", "http://notexample.net/de/8", "ftp://x.org/es/", "http://org?/es/1", "http://É.Org/es/1",
    "http://example.com?u=http://example.org/es/1", "http://a.com/en/7\nb", "x" * 70_000, "http://" + "a." * 3000 + "com/en/x",
]


def test_rules(spark, rows):
    df = spark.createDataFrame(list(enumerate(URLS + URLS)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, URL_RULES).collect()}
    assert got == {i: judge(u) for i, u in enumerate(URLS + URLS)}
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0 and {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_clashing_names(spark):
    df = spark.createDataFrame([("http://com/en/",)], "url string").selectExpr("*", "1 AS host", "'k' AS key", "2 AS verdict")
    assert url_filter.judge(df, URL_RULES).select("url", "host", "key", "verdict").first()[1:] == ("com", "k", "block")


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "_shape", lambda n, against: (1, 64 * (n // 32 + 1)))  # so that levels err
    keys = [f"k{i}" for i in range(3000)]
    listed = set(random.Random(1).sample(keys, 400))
    frame = lambda ks: spark.createDataFrame([(k,) for k in ks], "key string")
    cascade = url_filter.Cascade(frame(sorted(listed)), frame(keys))
    assert len(cascade.levels) > 3
    assert {r.key for r in frame(keys).filter(cascade.holds(F.col("key"))).collect()} == listed


def test_sizes_follow_the_list_not_the_corpus():
    few, many = (url_filter._shape(3, n)[1] for n in (2_000_000, 20_000_000_000))
    assert many <= 3 * few <= 600 and url_filter._shape(300_000, 20_000_000)[1] < 300_000 * 12


def long_list(n):
    return [url_filter.Rule("block" if i % 3 else "allow", f"h{i}.com", "/a/" if i % 2 else "") for i in range(n)]


@pytest.mark.parametrize("bits", [url_filter.LEVEL_BITS, 64])  # by cascade, and by join
def test_long_lists(spark, monkeypatch, bits):
    monkeypatch.setattr(url_filter, "LEVEL_BITS", bits)
    rules = long_list(20_000)
    by_key = {(r.host, r.path): r.verdict for r in rules}
    urls = [f"https://w.h{i}.com/{'a/' if i % 3 else ''}x" for i in range(0, 40_000, 7)] + [None, "x"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = r.host.removeprefix("w."), r.path[:3]
        want = next((k for k in ((host, path), (host, "")) if k in by_key), None)
        assert (r.rule, r.verdict) == (("".join(want), by_key[want]) if want else (None, "allow"))


def test_bad_rules(spark):
    df = spark.createDataFrame([("http://a",)], "url string")
    for rules in ([url_filter.Rule("block", "a", "/"), url_filter.Rule("allow", "a", "/")], [url_filter.Rule("maybe", "a", "/")]):
        with pytest.raises(ValueError, match="verdict"):
            url_filter.judge(df, rules)


def told(turns):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def digest(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(df).collect()}


HARD = [ODD_TEXT, "<|", "<\\|", "<\\\\|im_end|>\n", "a<", "|b", "<|im_start|>user\nhi<|im_end|>\n", "\n\n", "", "%0A %3C $1 \\1", "é😀<|x"]


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)]
    rows += [(2, 0, "sys\ntem<|%3C%", "x"), (2, 1, None, None), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (None, 5, "assistant", "z")]
    want = {1: told([(r, t) for _, _, r, t in rows[: len(HARD)]]), 2: told([("sys\ntem<|%3C%", "x"), ("", ""), ("assistant", "same"), ("assistant", "same")]), None: told([("assistant", "z")])}
    assert digest(spark, rows) == want
    assert chat.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool"]), st.text("<|\\im_endstart>\n %", max_size=20)), min_size=1, max_size=30))
def test_round_trip_on_noise(spark, turns):
    assert digest(spark, [(0, i, r, t) for i, (r, t) in enumerate(turns)]) == {0: told(turns)}


def test_no_control_string_survives_in_a_text(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    got = df.select("t", chat.escape_text(F.col("t")).alias("e"), chat.unescape_text(chat.escape_text(F.col("t"))).alias("u")).collect()
    assert all("<|" not in r.e and r.u == r.t for r in got)


LAYOUTS = [
    {"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
    {"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    {"id": 3, "prompt": "q", "completion": "a"},
    {"id": 4, "instruction": "q", "output": "a"},
    {"id": 5, "instruction": "q", "input": "more", "output": "a"},
    {"id": 6},
]


def test_layouts(spark):
    schema = """id long, messages array<struct<role: string, content: string>>, conversations array<struct<from: string, value: string>>,
        prompt string, completion string, response string, instruction string, input string, output string, system string"""
    df = spark.createDataFrame(LAYOUTS, schema)
    fields = [c for c in df.columns if c != "id"]
    got = {r.id: [(t.role, t.text) for t in r.turns] for r in chat.canonical_turns(df, fields).collect()}
    pair = [("user", "q"), ("assistant", "a")]
    assert got == {1: pair, 2: pair, 3: pair, 4: pair, 5: [("user", "q\n\nmore"), ("assistant", "a")], 6: []}
    assert len({r.layout for r in chat.canonical_turns(df, fields).collect()}) == 6
    with pytest.raises(Exception, match="no mapping for the layout"):
        chat.canonical_turns(df.withColumn("prompt", F.lit("stray")), fields).collect()


def test_mask_covers_what_is_learned(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "<|a"), (1, 2, "user", "z"), (1, 3, "assistant", "b")], "conv_id long, turn long, role string, text string")
    r = chat.write_template(chat.canonical_turns(chat.conversations_as_records(rows), ["messages"])).first()
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_mask] == ["<\\|a", "b"]


def test_running_sums(spark):
    data = [(list(range(n)),) for n in (0, 1, 2, 3, 7, 8, 9, 100)]
    for r in spark.createDataFrame(data, "x array<long>").withColumn("s", chat.running_sums(F.col("x"))).collect():
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x))]


def test_a_long_conversation(spark):
    turns = [("assistant" if i % 2 else "user", f"turn <|{i}|> é") for i in range(3000)]
    assert digest(spark, [(0, i, r, t) for i, (r, t) in enumerate(turns)]) == {0: told(turns)}
