"""Registered queries of the domain's rules, of upkeep, learning and artifacts, and their SQL.

Wherever a query needs a study's text, it is one of a few wordings chosen by a part's size;
the SQL states what each wording means.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import extract, rewrite, similarity
from quillon.operators import generate, index, learn, rank, retrieve, score, suggest, tables
from quillon.plans import catalogue, training
from quillon.plans.catalogue import ASKED_SQL, CATALOG_SQL, DENSE_SQL, HISTORY_SQL, JACCARD_SQL, MAPPED_SQL, PAIRS_SQL, POINTS_SQL, asked, catalog, dense, history, jaccard_pairs, mapped, neighbours, query, table
from quillon.rules import tables as T
from quillon.sources import readers
from quillon.storage import shared_dir, stash
from quillon.streaming import feedback


def folder(spark) -> str:
    """A new folder among the shared ones."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _case(of: str, values) -> str:
    return "CASE " + " ".join(f"WHEN {of} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _pick(column, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), column + 1)


# --- standard forms and edit ratios ----------------------------------------------------

FORMS = ("CT ANGIOGRAM WITH AND WITHOUT CONTRAST", "XR LEFT KNEE 2 VIEW", "MG TOMOSYNTHESIS BILATERAL", "US OB 2ND TRIMESTER TWIN")
catalogue.ORACLES["norm_standard_form"] = f"SELECT p_partkey, {_case('p_size % 4', [repr(f) for f in FORMS])} || ' ' || upper(p_name) AS norm FROM part"

#: Longest common subsequences of pairs p(k, x, y): a row of the table for each letter of x, as running maxima.
LCS_SQL = """l(k, i, r) AS (
      SELECT k, 0, list_transform(range(0, length(y) + 1), lambda z: 0) FROM p
      UNION ALL SELECT l.k, i + 1, list_transform(range(1, length(y) + 2), lambda j: CASE WHEN j = 1 THEN 0 ELSE
        list_max(list_transform(range(1, j), lambda h: greatest(r[h + 1], r[h] + CASE WHEN x[i + 1] = y[h] THEN 1 ELSE 0 END))) END)
      FROM l JOIN p ON l.k = p.k WHERE i < length(x)),
    s AS (SELECT p.k, CASE WHEN length(x) + length(y) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * list_max(r) / (length(x) + length(y)) END AS ratio FROM l JOIN p ON l.k = p.k AND i = length(x))"""

catalogue.ORACLES["fuzzy_ratio"] = (
    "WITH RECURSIVE " + PAIRS_SQL.replace("p AS", "n AS", 1) + """,
    w AS (SELECT k, x, y, list_sort(list_distinct(string_split(x, ' '))) AS a, list_sort(list_distinct(string_split(y, ' '))) AS b FROM n),
    c AS (SELECT *, array_to_string(list_filter(a, lambda t: list_contains(b, t)), ' ') AS shared, array_to_string(list_filter(a, lambda t: NOT list_contains(b, t)), ' ') AS own,
      array_to_string(list_filter(b, lambda t: NOT list_contains(a, t)), ' ') AS other FROM w),
    d AS (SELECT *, trim(shared || ' ' || own) AS with_a, trim(shared || ' ' || other) AS with_b FROM c),
    p AS (SELECT k * 2 AS k, x, y FROM d UNION ALL SELECT k * 2 + 1, with_a, with_b FROM d), """ + LCS_SQL + """
    SELECT d.k, f.ratio, CASE WHEN shared <> '' AND (own = '' OR other = '') THEN 100.0::DOUBLE WHEN shared = '' THEN g.ratio
      ELSE greatest(g.ratio, 200.0::DOUBLE * length(shared) / (length(shared) + length(with_a)), 200.0::DOUBLE * length(shared) / (length(shared) + length(with_b))) END / 100.0::DOUBLE AS token_set
    FROM d JOIN s f ON f.k = d.k * 2 JOIN s g ON g.k = d.k * 2 + 1"""
)

catalogue.ORACLES["parse_fuzzy_parts"] = (
    """WITH RECURSIVE t AS (SELECT DISTINCT upper(split_part(p_name, ' ', 2)) || 'S' AS token FROM part), v(n, word) AS (VALUES (0, 'WIDGET'), (1, 'PLATE'), (2, 'GIZMO'), (3, 'ANVIL')),
    p AS (SELECT token || '|' || n AS k, token, n, token AS x, word AS y FROM t, v WHERE length(token) >= 5), """ + LCS_SQL + """,
    b AS (SELECT token, y AS part, row_number() OVER (PARTITION BY token ORDER BY ratio DESC, n) AS place FROM p JOIN s ON s.k = p.k WHERE ratio >= 85)
    SELECT p_partkey, coalesce(b.part, '') AS parts FROM part LEFT JOIN b ON token = upper(split_part(p_name, ' ', 2)) || 'S' AND place = 1"""
)

USER_RULES = [(r"\bhot\b", "WARM"), (r"\b(red|blue)\b", r"\1DISH"), ("(", "never")]
USER_SQL = r"regexp_replace(regexp_replace({}, '\bhot\b', 'WARM', 'gi'), '\b(red|blue)\b', '\1DISH', 'gi')"


@query("SELECT p_partkey, upper(" + USER_SQL.format("upper(p_name)") + ") AS norm, " + USER_SQL.format("p_name") + " AS raw FROM part")
def user_rewrite_table(spark, sf_dir):
    """User rules, saved and read again, on normalised and on raw text; the bad one is left out."""
    path = folder(spark)
    readers.write_rules(spark, USER_RULES, path)
    rules = readers.read_rules(spark, path)
    return table(spark, sf_dir, "part").select("p_partkey", rewrite.normalize(F.col("p_name"), rules).alias("norm"), rewrite.apply_user_rules(F.col("p_name"), rules).alias("raw"))


# --- parsed studies --------------------------------------------------------------------

WORDINGS = ("CTA chest w/wo", "RF procedure wrist", "xr brst 2v rt", "US chestt twins 2nd tri", "ct head w contrast", "mr lt knee wo", "CHEST PA LAT", "tv us pelvis, biopsy")
READ_AS = (
    ("CT ANGIOGRAM CHEST WITH AND WITHOUT", "CT", None, "WWOC", "NONE", "CHEST", "ANGIOGRAM", False, None, False, False, False),
    ("RF PROCEDURE WRIST", "RF", None, "UNKNOWN", "NONE", "", "", False, "RF PROCEDURE", False, False, False),
    ("XR BRST 2 VIEW RIGHT", "XR", 2, "UNKNOWN", "RIGHT", "", "", False, None, False, False, False),
    ("US CHESTT TWIN 2ND TRIMESTER", "US", None, "UNKNOWN", "NONE", "CHEST", "", True, None, True, False, True),
    ("CT HEAD WITH CONTRAST", "CT", None, "WC", "NONE", "HEAD", "", False, None, False, False, False),
    ("MR LEFT KNEE WITHOUT", "MR", None, "WOC", "LEFT", "KNEE", "", False, None, False, False, False),
    ("CHEST PA LAT", "XR", 2, "UNKNOWN", "NONE", "CHEST", "", False, None, False, False, False),
    ("TRANSVAGINAL US PELVIS BIOPSY", "US", None, "UNKNOWN", "NONE", "PELVIS", "BIOPSY", False, None, False, True, False),
)
_NAMES = ("norm", "modality", "views", "contrast", "laterality", "parts", "procedures", "has_plurality", "generic", "late", "transvaginal", "twins")
_SAY = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"


@query(f"WITH w(i, {', '.join(_NAMES)}) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(_SAY, r))})" for i, r in enumerate(READ_AS)) + f") SELECT p_partkey, {', '.join(_NAMES)} FROM part JOIN w ON i = p_size % 8")
def parse_struct(spark, sf_dir):
    """All attributes of a study at once; a misspelt body part is guessed."""
    vocabulary = spark.range(1).select(F.explode(F.array(*map(F.lit, ["CHEST", "HEAD", "KNEE", "PELVIS"]))).alias("part"))
    asks = table(spark, sf_dir, "part").select("p_partkey", _pick(F.col("p_size") % 8, WORDINGS).alias("query"))
    q = F.col("q")
    return extract.parse(asks, vocabulary).select(
        "p_partkey", F.col("normalized").alias("norm"), q["modality"].alias("modality"), q["views"].alias("views"), q["contrast"].alias("contrast"), q["laterality"].alias("laterality"),
        F.array_join(q["body_parts"], "|").alias("parts"), F.array_join(q["procedure_keywords"], "|").alias("procedures"), q["has_plurality"].alias("has_plurality"),
        q["generic_procedure"].alias("generic"), q["is_late_trimester"].alias("late"), q["has_transvaginal"].alias("transvaginal"), q["has_twins"].alias("twins"),
    )


@query("""SELECT p_partkey, t LIKE '%CT%ANGIOGRAM%' OR t LIKE '%ANGIOGRAM%CT%' AS angiogram, CASE WHEN t LIKE '%US PROCEDURE%' THEN 'US PROCEDURE' WHEN t LIKE '%CT PROCEDURE%' THEN 'CT PROCEDURE' END AS procedure,
      CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN t LIKE '%US PROCEDURE%' THEN 150 WHEN t LIKE '%CT PROCEDURE%' THEN -100 ELSE -50 END
        ELSE CASE WHEN t LIKE '%CT PROCEDURE%' THEN 150 WHEN t LIKE '%US PROCEDURE%' THEN -100 ELSE -50 END END AS points
    FROM (SELECT p_partkey, p_size, ['CT HEAD ANGIOGRAM', 'ANGIOGRAM OF CT KIND', 'US PROCEDURE HIP', 'CT PROCEDURE', 'XR'][p_size % 5 + 1] AS t FROM part)""")
def angiogram_and_generic(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("t", _pick(F.col("p_size") % 5, ["CT HEAD ANGIOGRAM", "ANGIOGRAM OF CT KIND", "US PROCEDURE HIP", "CT PROCEDURE", "XR"]))
    wanted = F.when(F.col("p_size") % 3 == 1, "US PROCEDURE").when(F.col("p_size") % 3 == 2, "CT PROCEDURE")
    return rows.select("p_partkey", extract.is_angiogram(F.col("t")).alias("angiogram"), extract.generic_procedure(F.col("t")).alias("procedure"), similarity.generic_procedure_score(wanted, F.col("t")).alias("points"))


# --- the whole rule model, features and the older model ---------------------------------

SIDES, DYES = ("NONE", "LEFT", "RIGHT", "BI-LATERAL"), ("UNKNOWN", "WC", "WOC")


def judged(spark, sf_dir) -> DataFrame:
    """Pairs with a parsed query ``q`` and a catalog row, both made of two neighbouring parts."""
    n, m, x, y = (F.col(c) for c in "nmxy")
    q = F.struct(
        F.when(n % 3 == 0, "XR").when(n % 3 == 1, "CT").alias("modality"), F.when(n % 4 > 0, (n % 5).cast("int")).alias("views"), _pick(n % 3, DYES).alias("contrast"), _pick(n % 4, SIDES).alias("laterality"),
        F.when(n % 2 == 0, F.array(F.substring_index(x, " ", 1))).otherwise(F.array().cast("array<string>")).alias("body_parts"), extract.procedures(x, ("BOLT", "RING", "HOT")).alias("procedure_keywords"),
        F.when(n % 7 == 0, "RF PROCEDURE").alias("generic_procedure"), (n % 5 == 0).alias("has_plurality"), rewrite.tokens(x).alias("knowledge_tokens"),
    )
    desc = F.concat(y, F.when(m % 9 == 0, " TWIN").otherwise(""), F.when(m % 8 == 0, " RF PROCEDURE").otherwise(""), F.when(m % 11 == 0, " OBLIQUE").otherwise(""))
    regions = F.when(m % 3 > 0, F.array(F.substring_index(y, " ", 1))).otherwise(F.array().cast("array<string>"))
    rows = neighbours(spark, sf_dir).withColumn("q", q).withColumn("desc", desc).withColumn("regions", regions)
    return rows.select(
        "k", "n", "m", F.col("x").alias("normalized"), "q", "desc", "regions", rewrite.tokens(F.col("desc")).alias("tokens"), F.when(m % 2 == 0, "XR").otherwise("CT").alias("modality"), (m % 5).cast("int").alias("views"),
        (m % 6 == 0).alias("least_views"), _pick(m % 3, DYES).alias("contrast"), _pick(m % 4, SIDES).alias("laterality"), ((n % 10) / 10).alias("char_sim"), ((m % 10) / 10).alias("fuzzy"),
        (n / 50).alias("word_sim"), (m / 50).alias("embed_sim"), rewrite.tokens(y).alias("alias_tokens"), (n * m).alias("n_train"),
    )


def _abbreviations() -> str:
    hit = [f"(contains(x, '{a}') AND ({' OR '.join(f"contains(d, '{w}')" for w in words)}))::INT" for a, words in T.SYNONYMS.items()]
    hit += [f"(contains(x, '{a}') AND contains(d, '{e}'))::INT" for a, e in T.EXPANSIONS.items()]
    return f"least(1.0::DOUBLE, 0.3::DOUBLE * ({' + '.join(hit)}))"


_HAS = "contains(' ' || {} || ' ', ' ' || {} || ' ')"
JUDGED_SQL = "WITH " + PAIRS_SQL + f""", j AS (SELECT *, y || CASE WHEN m % 9 = 0 THEN ' TWIN' ELSE '' END || CASE WHEN m % 8 = 0 THEN ' RF PROCEDURE' ELSE '' END || CASE WHEN m % 11 = 0 THEN ' OBLIQUE' ELSE '' END AS d,
      CASE n % 3 WHEN 0 THEN 'XR' WHEN 1 THEN 'CT' END AS qm, CASE WHEN n % 4 > 0 THEN n % 5 END AS qv, {list(DYES)}[n % 3 + 1] AS qc, {list(SIDES)}[n % 4 + 1] AS ql,
      CASE WHEN n % 2 = 0 THEN [split_part(x, ' ', 1)] ELSE [] END AS qp, list_filter(['BOLT', 'RING', 'HOT'], lambda z: {_HAS.format('x', 'z')}) AS qk, list_distinct(string_split(x, ' ')) AS qt,
      CASE WHEN m % 2 = 0 THEN 'XR' ELSE 'CT' END AS cm, m % 5 AS cv, {list(DYES)}[m % 3 + 1] AS cc, {list(SIDES)}[m % 4 + 1] AS cl, CASE WHEN m % 3 > 0 THEN [split_part(y, ' ', 1)] ELSE [] END AS cr FROM p),
    o AS (SELECT *, list_distinct(string_split(d, ' ')) AS ct, len(list_intersect(qp, cr)) AS po, len(qp) > 0 AND contains(d, qp[1]) AS named,
      len(list_filter(qk, lambda z: {_HAS.format('d', 'z')})) AS kh FROM j),
    e AS (SELECT *, CASE WHEN qv IS NULL THEN 0 WHEN qv = cv THEN 100 WHEN m % 6 = 0 AND qv > cv THEN 90 WHEN abs(qv - cv) = 1 THEN -50 WHEN abs(qv - cv) = 2 THEN -100 ELSE -150 END AS t_views,
      CASE WHEN qc = 'UNKNOWN' THEN 0 WHEN qc = cc THEN 80 ELSE -120 END AS t_contrast, CASE WHEN ql = 'NONE' THEN 0 WHEN ql = cl THEN 60 WHEN cl = 'NONE' THEN 20 ELSE -150 END AS t_side,
      CASE WHEN len(qp) = 0 THEN 0 WHEN len(cr) > 0 THEN CASE WHEN po > 0 THEN po * 50 WHEN named THEN 50 ELSE -200 END WHEN named THEN 0 ELSE -300 END AS t_body,
      CASE WHEN len(qk) = 0 THEN 0.0::DOUBLE WHEN kh = 0 THEN -2.0::DOUBLE ELSE kh / len(qk) + CASE WHEN kh = len(qk) THEN 0.5::DOUBLE ELSE 0 END END AS proc,
      CASE WHEN n % 7 <> 0 THEN 0 WHEN m % 8 = 0 THEN 150 ELSE -50 END AS t_generic, {_abbreviations()} AS abbr,
      CASE WHEN n % 5 <> 0 THEN 0 WHEN m % 9 = 0 THEN 20 ELSE -60 END AS t_plural, CASE WHEN m % 11 = 0 THEN -40 ELSE 0 END AS t_modifier,
      CASE WHEN len(ct) = 0 THEN 0 ELSE len(list_intersect(ct, qt)) / len(ct) END AS known FROM o),
    z AS (SELECT *, CASE WHEN proc < 0 THEN -150 ELSE CAST(trunc(proc * 40) AS INTEGER) END AS t_proc FROM e),
    f AS (SELECT *, CASE WHEN qm <> cm THEN 0.0::DOUBLE ELSE greatest(0, 100 + t_views + t_contrast + t_side + t_body + t_proc + t_generic + abbr * 40 + t_plural + t_modifier
      + CAST(trunc(known * 30) AS INTEGER) + CAST(trunc((n % 10) / 10 * 50) AS INTEGER) + CAST(trunc((m % 10) / 10 * 30) AS INTEGER)) END AS rules FROM z)"""


def _scored(spark, sf_dir) -> DataFrame:
    rows = judged(spark, sf_dir)
    points = score._points("q", "normalized")
    other = F.col("q.modality").isNotNull() & (F.col("q.modality") != F.col("modality"))
    return rows.withColumn("score", score.rule_score(points, F.coalesce(other, F.lit(False))))


@query(JUDGED_SQL.replace("CASE WHEN qm <> cm", "CASE WHEN coalesce(qm <> cm, false)") + " SELECT k, round(rules, 6) AS score FROM f")
def rule_model(spark, sf_dir):
    """All thirteen terms of the shipped model, with its own tables."""
    return _scored(spark, sf_dir).select("k", F.round("score", 6).alias("score"))


_FEATURES_SQL = """round(coalesce(rules, 0), 6) AS f_rule_score, (n % 10) / 10 AS f_text_sim_char, round(n / 50, 6) AS f_text_sim_word, round(m / 50, 6) AS f_embed_sim, coalesce((qm = cm)::INT, 0)::DOUBLE AS f_modality_match,
      CASE WHEN qv IS NULL THEN 0.0::DOUBLE WHEN qv = cv OR (m % 6 = 0 AND qv > cv) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS f_view_match,
      CASE WHEN qc = 'UNKNOWN' THEN 0.0::DOUBLE WHEN qc = cc THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS f_contrast_match,
      CASE WHEN ql = 'NONE' THEN 0.0::DOUBLE WHEN ql = cl THEN 1.0::DOUBLE WHEN cl = 'NONE' THEN 0.5::DOUBLE ELSE -1.0::DOUBLE END AS f_laterality_match,
      CASE WHEN len(cr) > 0 AND len(qp) > 0 THEN (po / len(qp))::DOUBLE ELSE 0.0::DOUBLE END AS f_body_overlap, round(len(list_intersect(qt, ct)) / len(list_distinct(list_concat(qt, ct))), 6) AS f_token_overlap_jacc,
      round(levenshtein(x, d) / greatest(length(x), length(d)), 6) AS f_norm_edit_distance, round(proc, 6) AS f_proc_keyword_score, round(t_generic / 150, 6) AS f_generic_proc_score,
      round(len(list_intersect(qt, string_split(y, ' '))) / len(list_distinct(string_split(y, ' '))), 6) AS f_alias_overlap, round(ln(1 + n * m), 6) AS f_code_n_train, starts_with(d, x)::INT::DOUBLE AS f_is_exact_prefix"""


@query(JUDGED_SQL.replace("CASE WHEN qm <> cm", "CASE WHEN coalesce(qm <> cm, false)") + f" SELECT k, {_FEATURES_SQL} FROM f")
def ranker_features(spark, sf_dir):
    """The ranker's features but for the edit ratio, which ``fuzzy_ratio`` covers."""
    made = learn.features(_scored(spark, sf_dir))
    return made.select("k", *[F.round(f"f_{n}", 6).alias(f"f_{n}") for n in T.FEATURES if n != "fuzzy_ratio"])


@query(JUDGED_SQL.replace("CASE WHEN qm <> cm", "CASE WHEN coalesce(qm <> cm, false)") + """
    SELECT k, CASE WHEN qv IS NULL THEN 0.0::DOUBLE WHEN qv = cv THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS l_view_match, length(x)::DOUBLE AS l_query_length, length(d)::DOUBLE AS l_code_length, round(length(x) / length(d), 6) AS l_length_ratio,
      round(known, 6) AS l_knowledge_overlap, round(len(list_intersect(qt, ct)) / (len(qt) + len(ct)), 6) AS l_weighted_overlap, round(abbr, 6) AS l_abbreviation, (m % 10) / 10 AS l_fuzzy_ratio, round(n / 50, 6) AS l_text_sim_word FROM f""")
def legacy_features(spark, sf_dir):
    """What the older model's features have of their own; the others are the ranker's."""
    names = ("view_match", "query_length", "code_length", "length_ratio", "knowledge_overlap", "weighted_overlap", "abbreviation", "fuzzy_ratio", "text_sim_word")
    return learn.legacy_features(judged(spark, sf_dir).withColumn("score", F.lit(0.0))).select("k", *[F.round(f"l_{n}", 6).alias(f"l_{n}") for n in names])


@query(JUDGED_SQL.replace("CASE WHEN qm <> cm", "CASE WHEN coalesce(qm <> cm, false)") + """,
    g AS (SELECT *, (CAST(trunc((n * 2) / 100 * 500) AS INTEGER) + least(t_views, 0) + least(t_contrast, 0) + CASE WHEN t_side = -150 THEN -60 ELSE 0 END
      + CASE WHEN len(qp) = 0 OR po > 0 THEN 0 WHEN named THEN 50 ELSE -400 END + t_proc + t_generic + t_plural + t_modifier)::DOUBLE AS forest, len(qp) > 0 AND po = 0 AND NOT named AS differs FROM f)
    SELECT k, round(CASE WHEN NOT differs AND rules > forest THEN rules ELSE forest END, 6) AS score FROM g""")
def forest_or_rules(spark, sf_dir):
    """The better of the older model's points and the rules'."""
    total = score.forest_or_rules((F.col("n") * 2) / 100, F.col("score"), F.col("q"), F.col("normalized"))
    return _scored(spark, sf_dir).select("k", F.round(total, 6).alias("score"))


@query("WITH " + POINTS_SQL + """, s AS (SELECT k, other, CASE WHEN other THEN 0.0::DOUBLE ELSE greatest(views + modifiers + overlap, 0)::DOUBLE END AS score FROM q)
    SELECT k, score + CASE WHEN k = 10 AND NOT other THEN 175 ELSE 0 END + CASE WHEN k = 20 THEN 75 ELSE 0 END AS score FROM s WHERE score + CASE WHEN k = 10 AND NOT other THEN 175 ELSE 0 END + CASE WHEN k = 20 THEN 75 ELSE 0 END > 0""")
def boosted_scores(spark, sf_dir):
    """Conditional points by code, and only rows that score."""
    rows = neighbours(spark, sf_dir).withColumn("score", score.rule_score(catalogue._points(), F.col("n") > F.col("m")))
    return score.boosts(rows, [(10, "NOT n > m", 175), (20, "true", 75)], "k").filter("score > 0").select("k", "score")


@query("""SELECT p_partkey, CASE WHEN a = 'UNKNOWN' THEN 0.0::DOUBLE WHEN a = b THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS dye, CASE WHEN c = 'NONE' THEN 0.0::DOUBLE WHEN c = e THEN 1.0::DOUBLE WHEN e = 'NONE' THEN 0.5::DOUBLE ELSE -1.0::DOUBLE END AS side
    FROM (SELECT p_partkey, ['UNKNOWN', 'WC', 'WOC'][p_size % 3 + 1] AS a, ['UNKNOWN', 'WC', 'WOC'][p_partkey % 3 + 1] AS b, ['NONE', 'LEFT', 'RIGHT'][p_size % 3 + 1] AS c, ['NONE', 'LEFT', 'RIGHT'][p_partkey % 3 + 1] AS e FROM part)""")
def trit_features(spark, sf_dir):
    size, key, three = F.col("p_size") % 3, (F.col("p_partkey") % 3).cast("int"), SIDES[:3]
    return table(spark, sf_dir, "part").select("p_partkey", similarity.contrast_match(_pick(size, DYES), _pick(key, DYES)).alias("dye"), similarity.laterality_match(_pick(size, three), _pick(key, three)).alias("side"))


# --- learning --------------------------------------------------------------------------


@query(DENSE_SQL + """, s AS (SELECT qid, code, round(2.0::DOUBLE * sim - 0.5::DOUBLE * abs(qid - code) / 1000, 9) AS raw FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, code) AS rank FROM s)
    SELECT qid, code, round(raw, 6) AS raw, CAST(round_even(raw * 50 + 250, 0) AS INTEGER) AS display, rank FROM r WHERE rank <= 5""")
def ranker_order(spark, sf_dir):
    """Rows in the order of a saved and loaded ranker."""
    rows = dense(spark, sf_dir).select("qid", "code", F.col("sim").alias("f_sim"), (F.abs(F.col("qid") - F.col("code")) / 1000).alias("f_far"))
    path = folder(spark)
    learn.Ranker([2.0, -0.5], ["f_sim", "f_far"]).save(spark, path)
    raw = learn.Ranker.load(spark, path).score(rows).withColumn("raw", F.round("raw", 9))
    best = rank.ranked(raw, 5, score="raw", tie="code")
    return best.select("qid", "code", F.round("raw", 6).alias("raw"), similarity.display_score(F.col("raw")).alias("display"), F.col("rank").cast("bigint").alias("rank"))


@query(JACCARD_SQL + " SELECT qid, count(*) AS rows, CAST(1 AS BIGINT) AS positives FROM r GROUP BY qid")
def ranking_groups(spark, sf_dir):
    rows = rank.ranked(jaccard_pairs(spark, sf_dir), 10**6, score="sim", tie="code").select("qid", (F.col("rank") == 1).cast("int").alias("label"))
    return learn.group_sizes(rows)


@query(JACCARD_SQL + """, e AS (SELECT a.qid, c.code AS gold FROM a JOIN part ON p_partkey = a.qid JOIN c ON c.description = p_name), m AS (SELECT qid, code FROM r WHERE rank = 4),
    w AS (SELECT qid, gold AS code FROM e UNION SELECT qid, code FROM m) SELECT w.qid, w.code FROM w LEFT JOIN r ON r.qid = w.qid AND r.code = w.code AND r.rank <= 3 WHERE r.qid IS NULL""")
def forced_training_pairs(spark, sf_dir):
    """Gold and mined codes that the pool of candidates lacks."""
    ranked = stash(rank.ranked(jaccard_pairs(spark, sf_dir), 4, score="sim", tie="code").select("qid", "code", "rank"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("description"))
    gold = names.join(catalog(spark, sf_dir), "description").select("qid", F.col("code").alias("gold"))
    return training.forced_pairs(gold, ranked.filter("rank <= 3"), ranked.filter("rank = 4"))


@query("""SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS price FROM part""")
def standard_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return learn.scaled(rows, ["size", "price"]).select("p_partkey", F.round("size", 6).alias("size"), F.round("price", 6).alias("price"))


@query("""WITH b AS (SELECT floor(value)::INT AS margin, avg((event_type = 'click')::INT) AS correct FROM events GROUP BY 1),
    s AS (SELECT margin, row_number() OVER (ORDER BY margin) AS i, sum(correct) OVER (ORDER BY margin) AS upto, correct FROM b),
    m AS (SELECT j.i AS j, k.i AS k, (k.upto - j.upto + j.correct) / (k.i - j.i + 1) AS mean FROM s j JOIN s k ON j.i <= k.i),
    l AS (SELECT s.i, m.j, min(m.mean) AS low FROM s JOIN m ON m.j <= s.i AND m.k >= s.i GROUP BY s.i, m.j), f AS (SELECT i, max(low) AS fit FROM l GROUP BY i)
    SELECT margin, round(least(greatest(fit, 0), 1), 6) AS confidence FROM s JOIN f USING (i)""")
def isotonic_fit(spark, sf_dir):
    """Isotonic regression is the greatest of the least means of runs that hold a point."""
    rows = table(spark, sf_dir, "events").groupBy(F.floor("value").cast("int").alias("margin")).agg(F.avg((F.col("event_type") == "click").cast("int")).alias("correct"))
    rows = stash(rows)
    ranker = learn.calibrate(learn.Ranker([1.0], ["x"]), rows, least=1)
    return ranker.confidence(rows.select("margin"), "confidence").select("margin", F.round("confidence", 6).alias("confidence"))


@query()
def list_wise_trees(spark, sf_dir):
    """The first row of each query by boosted trees on list-wise gradients."""
    rows, names = catalogue._graded(spark, sf_dir)
    rows = stash(rows)
    ranker = learn.fit_tree_ranker(rows, names, rounds=4)
    return rank.ranked(ranker.score(rows), 1, score="raw", tie="code").select("qid", "code", "label")


@query("SELECT * FROM (VALUES ('start', 'done', 6.2::DOUBLE, 0.0::DOUBLE), ('codes', 'done', 15.6, 0.0), ('mappings', 'running', 18.8, 1.0), ('tfidf', 'waiting', 18.8, 3.0), ('model', 'waiting', 18.8, 10.0), ('save', 'waiting', 18.8, 12.0)) AS t(stage, state, percent, seconds_left)")
def training_status(spark, sf_dir):
    return training.status(spark, ["start", "codes"], 1.0)


# --- sources and upkeep ----------------------------------------------------------------


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS ix FROM part")
def row_numbers(spark, sf_dir):
    """Gapless numbers in the order of the file's rows."""
    return readers.with_row_number(table(spark, sf_dir, "part").select("p_partkey"))


@query("""SELECT CASE WHEN p_partkey % 10 > 0 THEN 'K' || p_partkey END AS code, p_name AS description, upper(p_name) AS desc_, CASE WHEN p_type = 'SMALL' THEN 'XR' ELSE p_type END AS modality, CASE p_size % 2 WHEN 0 THEN 'LEFT' ELSE 'NONE' END AS laterality,
      CASE p_size % 3 WHEN 0 THEN 'WC' ELSE 'UNKNOWN' END AS contrast, p_size AS views, upper(split_part(p_name, ' ', 2)) || '|' || upper(split_part(p_name, ' ', 1)) AS regions FROM part WHERE p_partkey % 10 > 0""")
def catalog_csv(spark, sf_dir):
    """A catalog written as CSV, read by its header and enriched; rows without a code go."""
    part, path = table(spark, sf_dir, "part"), folder(spark)
    rows = part.select(
        F.when(F.col("p_partkey") % 10 > 0, F.concat(F.lit(" K"), F.col("p_partkey").cast("string"))).alias("Code"), F.when(F.col("p_size") % 2 == 0, "lt").otherwise("N/A").alias("Laterality"),
        F.when(F.col("p_size") % 3 == 0, "wc").otherwise("N/A").alias("Contrast"), F.col("p_size").cast("string").alias("XR#Views"), F.col("p_name").alias("description"),
        F.when(F.col("p_type") == "SMALL", "cr").otherwise(F.col("p_type")).alias("modality"), F.concat(F.substring_index("p_name", " ", -1), F.lit("/ "), F.substring_index("p_name", " ", 1)).alias("bodyRegion"),
    )
    readers.write_catalog_csv(rows, path)
    out = readers.enrich_catalog(readers.read_catalog_csv(spark, path))
    return out.select("code", "description", F.col("desc").alias("desc_"), "modality", "laterality", "contrast", "views", F.array_join("regions", "|").alias("regions"))


@query("""SELECT l_orderkey || ', ' || l_linenumber AS query, 'K' || l_partkey AS code, upper(l_orderkey || ' ' || l_linenumber) AS norm FROM lineitem JOIN part ON p_partkey = l_partkey AND p_type <> 'PROMO'""")
def mappings_csv(spark, sf_dir):
    """Mappings written without a header and read again; unknown codes go."""
    path, line = folder(spark), table(spark, sf_dir, "lineitem")
    text = F.concat_ws(", ", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    readers.write_mappings_csv(line.select(text.alias("query"), F.concat(F.lit("K"), F.col("l_partkey").cast("string")).alias("code"), F.lit(None).cast("string").alias("note")), path)
    known = table(spark, sf_dir, "part").filter("p_type <> 'PROMO'").select(F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("code"))
    return readers.read_mappings(spark, path, known).select("query", "code", "norm")


@query("WITH " + CATALOG_SQL + " SELECT code, description, block AS modality FROM c")
def legend(spark, sf_dir):
    return readers.legend(catalog(spark, sf_dir).withColumnRenamed("block", "modality"))


@query("WITH " + HISTORY_SQL + " SELECT code, coalesce(method, '') AS method, 2 * count(*) AS n, min(id) AS first FROM h GROUP BY 1, 2")
def history_files(spark, sf_dir):
    """History appended twice and scanned."""
    path, e = folder(spark), history(spark, sf_dir)
    kinds = dict(part.strip().split(" ") for part in readers.HISTORY.split(","))
    rows = e.select(*[(F.col(c) if c in e.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    for _ in range(2):
        readers.append_history(rows, path)
    return readers.read_history(spark, path).groupBy("code", F.coalesce("method", F.lit("")).alias("method")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query("SELECT 250 AS min_score, 15 AS max_results, true AS review, '02:30' AS schedule, '***-key' AS api_key, true AS can_suggest")
def settings_round_trip(spark, sf_dir):
    """Settings saved, read and shown: bad numbers are ignored, the key is masked."""
    path = folder(spark)
    readers.write_settings(spark, readers.Settings.merged({"min_score": "250", "max_results": "many", "review": True, "schedule": "02:30", "api_key": "abc-key"}), path)
    found = readers.read_settings(spark, path)
    shown = found.shown()
    return spark.createDataFrame([(*shown.values(), found.can_suggest())], "min_score int, max_results int, review boolean, schedule string, api_key string, can_suggest boolean")


@query("WITH " + CATALOG_SQL + """, o AS (SELECT p_name AS query, p_type AS code FROM part WHERE p_size > 1) SELECT DISTINCT query, code FROM o UNION ALL SELECT DISTINCT p_name || ' (new)', p_type FROM part WHERE p_size = 1""")
def append_correction(spark, sf_dir):
    """A correction is added unless that very mapping, in standard form, is there."""
    part = table(spark, sf_dir, "part")
    old = part.filter("p_size > 1").select(F.col("p_name").alias("query"), F.col("p_type").alias("code")).distinct()
    again = old.withColumn("query", F.upper("query"))
    new = part.filter("p_size = 1").select(F.concat("p_name", F.lit(" (new)")).alias("query"), F.col("p_type").alias("code"))
    return tables.correction_mapping(again.unionByName(new), old)


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey = 5 THEN 'changed' ELSE p_name END AS query, CASE WHEN p_partkey = 5 THEN 'NEW' ELSE p_type END AS code FROM part WHERE p_partkey NOT IN (1, 2, 3)
    UNION ALL SELECT -1, 'added', 'X1'""")
def edit_tables(spark, sf_dir):
    """Rows deleted and changed, a code inserted once, a table emptied."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("query"), F.col("p_type").alias("code"))
    kept = tables.update_row(tables.delete_rows(rows, "id", [1, 2, 3]), "id", 5, {"query": "changed", "code": "NEW"})
    new = spark.createDataFrame([(-1, "added", "X1"), (-2, "twice", " new ")], "id long, query string, code string")
    if not tables.rename_allowed(kept, "id", 7, "fresh", "code") or tables.rename_allowed(kept, "id", 7, " new ", "code"):
        raise AssertionError("a code may be renamed to one that nobody else has")
    return tables.insert_code(kept, new).unionByName(tables.truncate(kept))


@query("""WITH o AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part WHERE p_size > 25 GROUP BY p_name), u AS (SELECT upper(p_name) AS p_name, min(p_partkey) AS p_partkey FROM part GROUP BY upper(p_name))
    SELECT p_name, p_partkey FROM o UNION ALL SELECT p_name, p_partkey FROM u WHERE p_name NOT IN (SELECT upper(p_name) FROM o)""")
def catalog_append(spark, sf_dir):
    """Uploaded rows appended to a catalog that has some of them, whatever their case."""
    part = table(spark, sf_dir, "part")
    old = part.filter("p_size > 25").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    return tables.upload(old, part.select(F.upper("p_name").alias("p_name"), "p_partkey"), "p_name", "p_partkey")


@query("""WITH k AS (SELECT event_id AS id, upper(event_type) AS key, event_type AS query, user_id AS code FROM events), chosen AS (SELECT DISTINCT key FROM k WHERE id % 1000 = 1)
    SELECT id, query, code, 'pending' AS state FROM k WHERE key NOT IN (SELECT key FROM chosen) UNION ALL
    SELECT min(id), arg_min(query, id), arg_min(code, id), 'agreed' FROM k WHERE id % 1000 = 1 GROUP BY key""")
def agreed_queue(spark, sf_dir):
    """Agreed suggestions leave the queue with every row of their query; the first of each becomes a mapping."""
    pending = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("query"), F.col("user_id").alias("suggested_code"))
    ids = [r.id for r in pending.filter("id % 1000 = 1").select("id").collect()]
    left, added = suggest.agree(pending, ids)
    first = pending.join(added.select("query").distinct(), "query", "left_semi").filter("id % 1000 = 1").groupBy("query").agg(F.min("id").alias("id"))
    rows = added.join(first, "query").select("id", "query", "code", F.lit("agreed").alias("state"))
    return left.select("id", "query", F.col("suggested_code").alias("code"), F.lit("pending").alias("state")).unionByName(rows)


@query("SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey % 5 = 0")
def full_scan(spark, sf_dir):
    """Queries without a block meet the whole catalog."""
    asks = table(spark, sf_dir, "supplier").filter("s_nationkey % 5 = 0").select("s_suppkey")
    return retrieve.full_scan(asks, table(spark, sf_dir, "nation").select("n_name"))


@query("""WITH d AS (SELECT DISTINCT upper(p_name) AS t FROM part), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), v AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS w FROM part)
    SELECT true AS same, (SELECT count(*) FROM (SELECT w FROM w EXCEPT SELECT w FROM v)) + (SELECT count(*) FROM (SELECT w FROM v EXCEPT SELECT w FROM w)) = 0 AS other""")
def same_vocabulary(spark, sf_dir):
    """Whether a saved index may be used again: its terms are those of the texts."""
    words = lambda text: index.term_counts(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower(text), " ").alias("w")), "id", F.col("w")).select("term").distinct()
    path = folder(spark)
    words("p_name").write.parquet(path)
    same, other = (index.same_vocabulary(spark.read.parquet(path), words(c)) for c in ("p_name", "p_type"))
    return spark.createDataFrame([(same, other)], "same boolean, other boolean")


@query("SELECT DISTINCT c.description AS variant_of, trim(regexp_replace(regexp_replace(c.description, '\\bhot\\b', '', 'gi'), '\\s+', ' ', 'g')) AS variant FROM (WITH " + CATALOG_SQL + " SELECT * FROM c) c WHERE regexp_matches(c.description, '\\bhot\\b', 'i')")
def variant_spaces(spark, sf_dir):
    """A variant that loses a word has single spaces."""
    out = generate.variants(catalog(spark, sf_dir), generate.rule_table(spark, ((r"\bhot\b", ("",)),)), depth=1)
    return out.join(catalog(spark, sf_dir), "code").select(F.col("description").alias("variant_of"), "variant")


# --- refreshing and streams ------------------------------------------------------------


@query("WITH " + MAPPED_SQL + """, t AS (SELECT code, array_to_string(list_sort(list_distinct(flatten(list(string_split(norm, ' '))))), ' ') AS tokens, count(*) AS n_train FROM m GROUP BY code)
    SELECT 'code ' || code AS key, tokens || ' ' || n_train AS value FROM t UNION ALL SELECT 'norm ' || norm, arg_max(code, (ix, code))::VARCHAR FROM m GROUP BY norm""")
def incremental_refresh(spark, sf_dir):
    """Alias tokens, counts and verified codes after a batch, from what was there before and what the batch touches."""
    every = mapped(spark, sf_dir).groupBy("norm", "ix", "code").count().drop("count")
    codes = every.select("code").distinct()
    batch, old = every.filter("ix % 7 = 3"), every.filter("ix % 7 <> 3")
    latest = lambda rows: retrieve.exact_map(rows, codes, order="ix")
    tokens, counts = feedback.refresh_aliases(index.alias_tokens(old), batch, every), feedback.refresh_counts(index.train_counts(old), batch, every)
    exact = feedback.refresh_exact(latest(old), batch, every, codes)
    value = F.concat_ws(" ", F.array_join("alias_tokens", " "), F.col("n_train").cast("string"))
    both = tokens.join(counts, "code").select(F.concat(F.lit("code "), F.col("code").cast("string")).alias("key"), value.alias("value"))
    return both.unionByName(exact.select(F.concat(F.lit("norm "), "norm").alias("key"), F.col("code").cast("string").alias("value")))


@query("SELECT count(DISTINCT user_id) AS examples, count(DISTINCT user_id) > 10 AS trained FROM events")
def retrain_stream(spark, sf_dir):
    """Files are watched, merged and trained on; each batch leaves its status."""
    base = folder(spark)
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet").withColumn("order", F.struct("ts", "event_id"))
    merge = feedback.retrainer(spark, base, "user_id", "order", lambda rows: True if rows.count() > 10 else None)
    feedback.apply_batches(stream, merge, f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/status").orderBy(F.desc("batch")).limit(1).select("examples", "trained")


@query("WITH " + ASKED_SQL + " SELECT qid, text AS query FROM a WHERE qid % 2 = 0")
def watched_reload(spark, sf_dir):
    """A table that is read again when its files change, with what is made of it."""
    path, rows = folder(spark), asked(spark, sf_dir)
    rows.limit(1).write.parquet(path)
    watched = readers.Watched(spark, path, lambda: spark.read.parquet(path), lambda df: df.select("qid", F.col("text").alias("query")))
    watched.get()
    rows.filter("qid % 2 = 0").write.mode("overwrite").parquet(path)
    return watched.get()
