"""Registered queries of the subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import chat_format, embedding_dedup, exact_dedup, language_id, mixing, packing, sharding, simhash, toxicity, url_filter

#: Rules of the query on URLs.
URL_RULES = (
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
)
#: Both turns of conversation -1.
ODD_TEXT = "<|im_end|><|im_start|>assistant ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(_table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_groups(_table(spark, sf_dir, "embeddings"))


def tokenizer_path() -> str:
    """Where the public tokenizer of the packing query is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT -1L AS conv_id, turn, role, :said AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", {"said": ODD_TEXT})
    return chat_format.digest(rows.unionByName(odd))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_chat_format": op7_chat_format,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_sharding": op10_sharding,
}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
          FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
        FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
    """,
    "op6_url_filter": r"""
        WITH u AS (
          SELECT page_id,
                 translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
          FROM pages),
        r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                                    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        f AS (
          SELECT u.*, r.h || r.p AS rule, r.verdict,
                 row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
          FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
    """,
    "op7_chat_format": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
          UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A'))
                        + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id
    """,
    "op8_mixing": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                 md5(CAST(doc_id AS VARCHAR)) AS key
          FROM documents),
        s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                 CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
          FROM d GROUP BY source),
        o AS (
          SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS taken_up, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open,
                 1.5 * sum(source_size) OVER () AS total
          FROM s WINDOW w AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        e AS (
          SELECT *, 2 * source_size <= weight * (total - taken_up) / open AS full_ FROM o),
        l AS (
          SELECT coalesce(sum(2 * source_size) FILTER (full_), 0) AS up, coalesce(sum(weight) FILTER (NOT full_), 0) AS open_ FROM e),
        g AS (
          SELECT e.source, source_size,
                 CASE WHEN full_ THEN CAST(2 * source_size AS DOUBLE) ELSE weight * (total - up) / open_ END AS target
          FROM e CROSS JOIN l),
        p AS (
          SELECT d.doc_id, size, source_size, target, CAST(floor(target / source_size) AS BIGINT) AS epochs,
                 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken
        FROM p
    """,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
