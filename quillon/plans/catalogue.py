"""Registered queries over the driver's tables, and their SQL.

The catalog is made of ``part``: each distinct name is a row, its code the smallest
key.  Queries are all rows of ``part``, worded differently.  Every query reads its
tables whole; the queries of a vector search are those whose id is divisible by 50.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import extract, rewrite, similarity
from quillon.operators import generate, index, learn, rank, retrieve, score, suggest, tables
from quillon.operators.sized import small
from quillon.plans import match
from quillon.sources import readers
from quillon.storage import shared_dir, stash
from quillon.streaming import feedback

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "token_jaccard_topk"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, description, block, views): one row for each part name."""
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_name").alias("description")).agg(
        F.min("p_partkey").alias("code"), F.min("p_type").alias("block"), F.min("p_size").alias("views")
    )


CATALOG_SQL = "c AS (SELECT p_name AS description, min(p_partkey) AS code, min(p_type) AS block, min(p_size) AS views FROM part GROUP BY p_name)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, text): each part's name with its words turned, or its type in front."""
    part = table(spark, sf_dir, "part")
    turned = F.concat_ws(" ", F.substring_index("p_name", " ", -1), F.substring_index("p_name", " ", 1))
    return part.select(F.col("p_partkey").alias("qid"), F.when(F.col("p_size") > 25, turned).otherwise(F.concat_ws(" ", F.lower("p_type"), "p_name")).alias("text"))


ASKED_SQL = """a AS (SELECT p_partkey AS qid, CASE WHEN p_size > 25 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
    ELSE lower(p_type) || ' ' || p_name END AS text FROM part)"""

# --- text -----------------------------------------------------------------------------

WORD_RULES = [(r"\bSMALL\b", "SM"), (r"\bLARGE\b", "LG"), (r"\bBOLTS?\b|\bRODS?\b", "FASTENER"), (r"\bSIZE\s+(\d+)\b", r"SZ\1"), (r"[^A-Z0-9 ]+", " "), (r"\s{2,}", " ")]


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      upper(p_name || ' / ' || p_brand || ' size ' || p_size), '\bSMALL\b', 'SM', 'g'), '\bLARGE\b', 'LG', 'g'),
      '\bBOLTS?\b|\bRODS?\b', 'FASTENER', 'g'), '\bSIZE\s+(\d+)\b', 'SZ\1', 'g'), '[^A-Z0-9 ]+', ' ', 'g'), '\s{2,}', ' ', 'g')) AS norm
    FROM part""")
def norm_rewrite_chain(spark, sf_dir):
    text = F.upper(F.concat(F.col("p_name"), F.lit(" / "), F.col("p_brand"), F.lit(" size "), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", rewrite.cleanup(rewrite.fold_rules(text, WORD_RULES)).alias("norm"))


@query()
def norm_standard_form(spark, sf_dir):
    """The full rule table (beyond what the SQL side's expressions can say) over worded parts."""
    word = F.element_at(F.array(*map(F.lit, ["CTA w/wo cont", "XR lt knee 2v", "mammo 3D bilat", "US OB 2nd tri twins"])), (F.col("p_size") % 4 + 1))
    return table(spark, sf_dir, "part").select("p_partkey", rewrite.normalize(F.concat_ws(" ", word, "p_name")).alias("norm"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(t, '\b(RING|GEAR)\b')
      THEN regexp_replace(regexp_replace(t, '\bHOT\b', 'HEATED', 'g'), '\bCOLD\b', 'COOLED', 'g') ELSE t END AS norm
    FROM (SELECT p_partkey, upper(p_name) AS t FROM part)""")
def norm_conditional_rewrite(spark, sf_dir):
    rules = [(r"\bHOT\b", "HEATED"), (r"\bCOLD\b", "COOLED")]
    return table(spark, sf_dir, "part").select("p_partkey", rewrite.conditional_rewrite(F.upper("p_name"), r"\b(?:RING|GEAR)\b", rules).alias("norm"))


@query(r"""SELECT p_partkey, upper(trim(regexp_replace(translate(t, chr(13) || chr(10) || chr(9) || ',', '    '), '\s+', ' ', 'g'))) AS mapping_key,
      upper(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS review_key
    FROM (SELECT p_partkey, ' ' || p_name || chr(9) || p_brand || ',  ' || p_type || chr(10) AS t FROM part)""")
def mapping_key_sanitize(spark, sf_dir):
    t = F.concat(F.lit(" "), "p_name", F.lit("\t"), "p_brand", F.lit(",  "), "p_type", F.lit("\n"))
    return table(spark, sf_dir, "part").select("p_partkey", rewrite.mapping_key(t).alias("mapping_key"), rewrite.review_key(t).alias("review_key"))


@query(r"""SELECT qid, array_to_string(list_sort(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))), ' ') AS tokens
    FROM (WITH """ + ASKED_SQL + " SELECT * FROM a)")
def tokenize(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", F.array_join(F.array_sort(rewrite.tokens(F.col("text"))), " ").alias("tokens"))


# --- extraction -----------------------------------------------------------------------


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(t, '\b(BOLT|ROD)\b') THEN 'FASTENER' WHEN regexp_matches(t, '\b(RING|GEAR)\b') THEN 'ROUND'
      WHEN regexp_matches(t, '\bPLATE\b') THEN 'FLAT' END AS kind FROM (SELECT p_partkey, upper(p_name) AS t FROM part)""")
def parse_first_match_enum(spark, sf_dir):
    patterns = ((r"\b(?:BOLT|ROD)\b", "FASTENER"), (r"\b(?:RING|GEAR)\b", "ROUND"), (r"\bPLATE\b", "FLAT"))
    return table(spark, sf_dir, "part").select("p_partkey", extract.first_match(F.upper("p_name"), patterns).alias("kind"))


STUDIES = ["CT HEAD WITH AND WITHOUT CONTRAST", "MR KNEE LEFT WITHOUT", "XR FOOT RIGHT PA LATERAL", "US PELVIS TWIN 2ND TRIMESTER", "MG BREAST BILATERAL {} VIEW", "CHEST {} V", "SINUS UNILATERAL WITH CONTRAST", "HEART CONTRAST LEFT RIGHT"]
STUDY_SQL = "s AS (SELECT p_partkey, replace([" + ", ".join(f"'{s}'" for s in STUDIES) + "][p_size % 8 + 1], '{}', p_size::VARCHAR) AS t FROM part)"


def studies(spark, sf_dir) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, STUDIES)), (F.col("p_size") % 8 + 1))
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(pick, F.lit("{}"), F.col("p_size").cast("string")).alias("t"))


@query("WITH " + STUDY_SQL + r"""
    SELECT p_partkey, coalesce(try_cast(nullif(regexp_extract(t, '\b(\d+)\s*VIEW\b', 1), '') AS INTEGER), try_cast(nullif(regexp_extract(t, '\b(\d+)\s*V\b', 1), '') AS INTEGER),
      CASE WHEN regexp_matches(t, '\b(PA|AP)\b') AND regexp_matches(t, '\b(LAT|LATERAL)\b') THEN 2 END) AS views FROM s""")
def parse_view_count(spark, sf_dir):
    return studies(spark, sf_dir).select("p_partkey", extract.views(F.col("t")).alias("views"))


@query("WITH " + STUDY_SQL + r"""
    SELECT p_partkey, CASE WHEN contains(t, 'WITH AND WITHOUT') THEN 'WWOC' WHEN regexp_matches(t, '\bWITHOUT\b') THEN 'WOC' WHEN NOT contains(t, 'CONTRAST') THEN 'UNKNOWN'
      WHEN regexp_matches(t, '\bWITH\b') THEN 'WC' ELSE 'UNKNOWN' END AS contrast FROM s""")
def parse_polarity(spark, sf_dir):
    return studies(spark, sf_dir).select("p_partkey", extract.contrast(F.col("t"), F.col("t")).alias("contrast"))


@query("WITH " + STUDY_SQL + r"""
    SELECT p_partkey, CASE WHEN regexp_matches(t, '\bUNILATERAL\b') THEN 'NONE'
      WHEN regexp_matches(t, '\bBILATERAL\b') OR (regexp_matches(t, '\bLEFT\b') AND regexp_matches(t, '\bRIGHT\b')) THEN 'BI-LATERAL'
      WHEN regexp_matches(t, '\bLEFT\b') THEN 'LEFT' WHEN regexp_matches(t, '\bRIGHT\b') THEN 'RIGHT' ELSE 'NONE' END AS laterality FROM s""")
def parse_side(spark, sf_dir):
    return studies(spark, sf_dir).select("p_partkey", extract.laterality(F.col("t")).alias("laterality"))


@query("WITH " + STUDY_SQL + r"""
    SELECT p_partkey, CASE WHEN regexp_matches(t, '\bCT\b') THEN 'CT' WHEN regexp_matches(t, '\bMR\b') THEN 'MR' WHEN regexp_matches(t, '\bUS\b') THEN 'US'
      WHEN regexp_matches(t, '\bXR\b') THEN 'XR' WHEN regexp_matches(t, '\bMG\b') THEN 'MG' WHEN regexp_matches(t, '\d+ (V|VIEW)\b') THEN 'XR'
      WHEN regexp_matches(t, '\bSINUS\b') THEN 'XR' WHEN regexp_matches(t, '\bHEART\b') THEN 'NM' END AS modality FROM s""")
def parse_modality(spark, sf_dir):
    return studies(spark, sf_dir).select("p_partkey", extract.modality(F.col("t")).alias("modality"))


@query("WITH " + STUDY_SQL + r"""
    SELECT p_partkey, regexp_matches(t, '\b(TWINS?|TRIPLETS?|MULTIPLE)\b') AS is_plural, regexp_matches(t, '\b(2ND|SECOND|3RD|THIRD)\s*(TRIMESTER|TRI)\b') AS is_late_trimester,
      regexp_matches(t, '\b(TV|ENDO)\b') AS has_transvaginal, regexp_matches(t, '\bTWINS?\b') AS has_twins,
      regexp_matches(t, '\bMIN(IMUM)?\b\s*\d*\s*(VIEW|VW)|\d\s*\+\s*(VIEW|VW)') AS least_views FROM s""")
def parse_flags(spark, sf_dir):
    t = F.col("t")
    return studies(spark, sf_dir).select("p_partkey", extract.plural(t).alias("is_plural"), *[c.alias(n) for n, c in extract.flags(t, t).items()], extract.states_least_views(t).alias("least_views"))


@query("WITH " + STUDY_SQL + r""", v AS (SELECT list_sort(list_distinct(['ABDOMEN', 'BREAST', 'CHEST', 'FOOT', 'HEAD', 'HEART', 'KNEE', 'PELVIS', 'LEFT', 'RIGHT'])) AS vocab)
    SELECT p_partkey, array_to_string(list_filter(list_slice(list_concat(list_filter(vocab, lambda x: contains(' ' || t || ' ', ' ' || x || ' ')),
      CASE WHEN contains(' ' || t || ' ', ' SINUS ') THEN ['FACE'] ELSE [] END), 1, 3), lambda x: x NOT IN ('LEFT', 'CT')), '|') AS parts FROM s, v""")
def parse_vocab_hits(spark, sf_dir):
    vocab = F.array_sort(F.array(*map(F.lit, ["ABDOMEN", "BREAST", "CHEST", "FOOT", "HEAD", "HEART", "KNEE", "PELVIS", "LEFT", "RIGHT"])))
    parts = extract.body_parts(F.col("t"), vocab, {"SINUS": "FACE"}, ("LEFT", "CT"))
    return studies(spark, sf_dir).select("p_partkey", F.array_join(parts, "|").alias("parts"))


@query(r"""SELECT DISTINCT trim(regexp_replace(regexp_replace(upper(part), '[^A-Z0-9 ]+', ' ', 'g'), ' {2,}', ' ', 'g')) AS part
    FROM (SELECT unnest(string_split(p_name || ',' || p_type, ',')) AS part FROM part UNION ALL SELECT unnest(['CHEST', 'KNEE'])) WHERE part <> ''""")
def region_vocabulary(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.split(F.concat_ws(",", "p_name", "p_type"), ",").alias("region"))
    return extract.body_vocabulary(rows, "region", ("CHEST", "KNEE"))


@query()
def parse_fuzzy_parts(spark, sf_dir):
    """Misspelt names against the vocabulary; the SQL is in :mod:`quillon.plans.catalogue_domain`."""
    vocab = F.array(*map(F.lit, ["WIDGET", "PLATE", "GIZMO", "ANVIL"]))
    bad = F.upper(F.concat(F.substring_index("p_name", " ", -1), F.lit("S")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.fuzzy_parts(bad, vocab), "|").alias("parts"))


@query("WITH " + STUDY_SQL + r"""
    SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(t, ' '), CASE WHEN regexp_matches(t, '\bHEAD\b') THEN ['NECK', 'FACE'] ELSE [] END,
      CASE WHEN regexp_matches(t, '\bPELVIS\b') THEN ['ABDOMEN'] ELSE [] END))), ' ') AS tokens FROM s""")
def expand_hints(spark, sf_dir):
    hints = ((r"\bHEAD\b", ("NECK", "FACE")), (r"\bPELVIS\b", ("ABDOMEN",)))
    return studies(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(extract.expand_hints(F.col("t"), hints)), " ").alias("tokens"))


@query(r"""SELECT p_partkey, CASE WHEN upper(p_type) IN ('CR', 'XR', 'DX') THEN 'XR' WHEN upper(p_type) = '' THEN 'UNKNOWN' ELSE upper(p_type) END AS modality,
      CASE WHEN p_size % 4 = 0 THEN 'LEFT' WHEN p_size % 4 = 1 THEN 'BI-LATERAL' ELSE 'NONE' END AS laterality,
      CASE WHEN p_size % 3 = 0 THEN 'WC' ELSE 'UNKNOWN' END AS contrast, CASE WHEN p_size % 5 = 0 THEN 1 ELSE p_size END AS views,
      array_to_string(list_sort(list_filter([upper(split_part(p_name, ' ', 1)), upper(split_part(p_name, ' ', 2))], lambda x: x <> 'OLD')), '|') AS regions FROM part""")
def catalog_enums(spark, sf_dir):
    c = F.col
    side = F.when(c("p_size") % 4 == 0, "lt").when(c("p_size") % 4 == 1, "Bilateral").otherwise("N/A")
    regions = extract.catalog_regions(F.replace(F.regexp_replace("p_name", "^old", "none"), F.lit(" "), F.lit(" / ")))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        extract.catalog_modality(c("p_type")).alias("modality"),
        extract.catalog_laterality(side).alias("laterality"),
        extract.catalog_contrast(F.when(c("p_size") % 3 == 0, "wc").otherwise("N/A")).alias("contrast"),
        extract.catalog_views(F.when(c("p_size") % 5 == 0, "n/a").otherwise(c("p_size").cast("string"))).alias("views"),
        F.array_join(F.array_sort(regions), "|").alias("regions"),
    )


# --- scores of pairs ------------------------------------------------------------------

PAIRS_SQL = "p AS (SELECT a.p_partkey AS k, upper(a.p_name) AS x, upper(b.p_name || ' ' || b.p_type) AS y, a.p_size AS n, b.p_size AS m FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def neighbours(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    a = part.select(F.col("p_partkey").alias("k"), F.upper("p_name").alias("x"), F.col("p_size").alias("n"))
    b = part.select((F.col("p_partkey") - 1).alias("k"), F.upper(F.concat_ws(" ", "p_name", "p_type")).alias("y"), F.col("p_size").alias("m"))
    return a.join(b, "k")


@query("WITH " + PAIRS_SQL + " SELECT k, round(levenshtein(x, y) / greatest(length(x), length(y)), 6) AS distance FROM p")
def levenshtein_norm(spark, sf_dir):
    return neighbours(spark, sf_dir).select("k", F.round(similarity.edit_distance(F.col("x"), F.col("y")), 6).alias("distance"))


@query()
def fuzzy_ratio(spark, sf_dir):
    """Edit and token-set ratios; the SQL, with a recursive table, is in :mod:`quillon.plans.catalogue_domain`."""
    return neighbours(spark, sf_dir).select("k", similarity.ratio(F.col("x"), F.col("y")).alias("ratio"), similarity.fuzzy(F.col("x"), F.col("y")).alias("token_set"))


@query("WITH " + PAIRS_SQL + r""", t AS (SELECT k, list_distinct(string_split(x, ' ')) AS a, list_distinct(string_split(y, ' ')) AS b FROM p),
    u AS (SELECT k, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM t)
    SELECT k, round(i / (na + nb - i), 6) AS jaccard, round(i / (na + nb), 6) AS weighted, round(i / nb, 6) AS coverage FROM u""")
def token_overlaps(spark, sf_dir):
    a, b = rewrite.tokens(F.col("x")), rewrite.tokens(F.col("y"))
    scores = {"jaccard": similarity.jaccard(a, b), "weighted": similarity.weighted_overlap(a, b), "coverage": similarity.coverage(b, a)}
    return neighbours(spark, sf_dir).select("k", *[F.round(c, 6).alias(n) for n, c in scores.items()])


@query("WITH " + PAIRS_SQL + " SELECT k, CASE WHEN starts_with(y, x) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_prefix FROM p")
def prefix_match(spark, sf_dir):
    return neighbours(spark, sf_dir).select("k", similarity.is_prefix(F.col("x"), F.col("y")).alias("is_prefix"))


@query("WITH " + PAIRS_SQL + """ SELECT k, round(least(1.0::DOUBLE, 0.3::DOUBLE * ((contains(x, 'BOLT') AND (contains(y, 'ROD') OR contains(y, 'BOLT')))::INT
      + (contains(x, 'RED') AND contains(y, 'BLUE'))::INT + (contains(x, 'OLD') AND contains(y, 'NEW'))::INT)), 6) AS score FROM p""")
def abbrev_score(spark, sf_dir):
    s = similarity.abbreviation_score(F.col("x"), F.col("y"), {"BOLT": ("ROD", "BOLT")}, {"RED": "BLUE", "OLD": "NEW"})
    return neighbours(spark, sf_dir).select("k", F.round(s, 6).alias("score"))


@query("WITH " + PAIRS_SQL + """ SELECT k, -(CASE WHEN contains(y, 'HOT') AND NOT contains(x, 'HOT') THEN 40 ELSE 0 END
      + CASE WHEN contains(y, 'PROMO') AND NOT contains(x, 'PROMO') THEN 20 ELSE 0 END) AS penalty FROM p""")
def modifier_penalty(spark, sf_dir):
    return neighbours(spark, sf_dir).select("k", similarity.modifier_penalty(F.col("x"), F.col("y"), {"HOT": 40, "PROMO": 20}).alias("penalty"))


@query("WITH " + PAIRS_SQL + """ SELECT k, CASE WHEN n IS NULL THEN 0 WHEN n = m THEN 100 WHEN contains(y, 'LARGE') AND n > m THEN 90
      WHEN abs(n - m) = 1 THEN -50 WHEN abs(n - m) = 2 THEN -100 ELSE -150 END AS points,
      CASE WHEN n = m OR (contains(y, 'LARGE') AND n > m) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS match FROM p""")
def view_score(spark, sf_dir):
    n, m, least = F.col("n"), F.col("m"), F.col("y").contains("LARGE")
    return neighbours(spark, sf_dir).select("k", similarity.view_score(n, m, least).alias("points"), similarity.view_match(n, m, least).alias("match"))


@query("WITH " + PAIRS_SQL + r""", w AS (SELECT k, list_filter(['BOLT', 'RING', 'HOT', 'SMALL'], lambda z: contains(' ' || x || ' ', ' ' || z || ' ')) AS kw, y FROM p),
    h AS (SELECT k, len(kw) AS n, len(list_filter(kw, lambda z: contains(' ' || y || ' ', ' ' || z || ' ') OR (z = 'BOLT' AND regexp_matches(y, '\bRODS?\b')))) AS i, kw FROM w)
    SELECT k, array_to_string(kw, '|') AS keywords, round(CASE WHEN n = 0 THEN 0 WHEN i = 0 THEN -2 ELSE i / n + CASE WHEN i = n THEN 0.5 ELSE 0 END END, 6)::DOUBLE AS score FROM h""")
def keyword_set_score(spark, sf_dir):
    kw = extract.procedures(F.col("x"), ("BOLT", "RING", "HOT", "SMALL"))
    rows = neighbours(spark, sf_dir).withColumn("kw", kw)
    return rows.select("k", F.array_join("kw", "|").alias("keywords"), F.round(similarity.procedure_score(F.col("kw"), F.col("y"), {"BOLT": r"\bRODS?\b"}), 6).alias("score"))


@query("WITH " + PAIRS_SQL + """ SELECT k, CASE WHEN n * 10 >= 350 THEN 'HIGH' WHEN n * 10 >= 200 THEN 'MEDIUM' ELSE 'LOW' END AS band,
      CAST(round_even(n / 8.0 * 50 + 250, 0) AS INTEGER) AS display FROM p""")
def confidence_band(spark, sf_dir):
    return neighbours(spark, sf_dir).select("k", similarity.confidence_band(F.col("n") * 10).alias("band"), similarity.display_score(F.col("n") / 8).alias("display"))


@query("""WITH n AS (SELECT l_partkey AS code, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT p_partkey, round(ln(1 + coalesce(n, 0)), 6) AS popularity FROM part LEFT JOIN n ON code = p_partkey""")
def log_popularity(spark, sf_dir):
    counts = index.train_counts(table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey")
    return table(spark, sf_dir, "part").join(counts, "p_partkey", "left").select("p_partkey", F.round(similarity.log_popularity(F.col("n_train")), 6).alias("popularity"))


def _points() -> dict:
    n, m, x, y = (F.col(c) for c in "nmxy")
    return {
        "views": similarity.view_score(n, m, y.contains("LARGE")),
        "modifiers": similarity.modifier_penalty(x, y, {"HOT": 40, "PROMO": 20}),
        "overlap": (similarity.coverage(rewrite.tokens(x), rewrite.tokens(y)) * 300).cast("int"),
    }


POINTS_SQL = PAIRS_SQL + """, q AS (SELECT k, CASE WHEN n = m THEN 100 WHEN contains(y, 'LARGE') AND n > m THEN 90 WHEN abs(n - m) = 1 THEN -50 WHEN abs(n - m) = 2 THEN -100 ELSE -150 END AS views,
      -(CASE WHEN contains(y, 'HOT') AND NOT contains(x, 'HOT') THEN 40 ELSE 0 END + CASE WHEN contains(y, 'PROMO') AND NOT contains(x, 'PROMO') THEN 20 ELSE 0 END) AS modifiers,
      CAST(trunc(len(list_intersect(list_distinct(string_split(x, ' ')), string_split(y, ' '))) / len(list_distinct(string_split(x, ' '))) * 300) AS INTEGER) AS overlap, n > m AS other FROM p)"""


@query("WITH " + POINTS_SQL + " SELECT k, CASE WHEN other THEN 0.0::DOUBLE ELSE greatest(views + modifiers + overlap, 0)::DOUBLE END AS score FROM q")
def rule_score(spark, sf_dir):
    return neighbours(spark, sf_dir).select("k", score.rule_score(_points(), F.col("n") > F.col("m")).alias("score"))


@query("WITH " + POINTS_SQL + """, l AS (SELECT k, unnest([{'component': 'views', 'value': views}, {'component': 'modifiers', 'value': modifiers}, {'component': 'overlap', 'value': overlap},
      {'component': 'TOTAL', 'value': greatest(views + modifiers + overlap, 0)}]) AS r FROM q)
    SELECT k, r.component AS component, CAST(r.value AS INTEGER) AS value FROM l WHERE r.component = 'TOTAL' OR r.value <> 0""")
def rule_score_log(spark, sf_dir):
    log = score.score_log(_points(), score.rule_score(_points()))
    return neighbours(spark, sf_dir).select("k", F.explode(log).alias("r")).select("k", "r.component", "r.value")


# --- retrieval and ranking ------------------------------------------------------------


def jaccard_pairs(spark, sf_dir) -> DataFrame:
    """Scores of queries and the catalog rows that share a word with them, found by the word."""
    words = lambda df, id, text: df.select(id, rewrite.tokens(F.col(text)).alias("ws")).withColumn("n", F.size("ws"))
    q = words(asked(spark, sf_dir), "qid", "text").select("qid", F.col("n").alias("nq"), F.explode("ws").alias("w"))
    c = words(catalog(spark, sf_dir), "code", "description").select("code", F.col("n").alias("nc"), F.explode("ws").alias("w"))
    met = q.join(c, "w").groupBy("qid", "code", "nq", "nc").agg(F.count(F.lit(1)).alias("i"))
    return met.select("qid", "code", (F.col("i") / (F.col("nq") + F.col("nc") - F.col("i"))).alias("sim"))


JACCARD_SQL = "WITH " + CATALOG_SQL + ", " + ASKED_SQL + """, j AS (SELECT qid, code, block, views, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS sim
      FROM (SELECT qid, list_distinct(string_split(text, ' ')) AS x FROM a), (SELECT code, block, views, list_distinct(string_split(description, ' ')) AS y FROM c)
      WHERE len(list_intersect(x, y)) > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, code) AS rank FROM j)"""


@query(JACCARD_SQL + " SELECT qid, code, round(sim, 6) AS sim, rank FROM r WHERE rank <= 3")
def token_jaccard_topk(spark, sf_dir):
    return rank.ranked(jaccard_pairs(spark, sf_dir), 3, score="sim", tie="code").select("qid", "code", F.round("sim", 6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


MAPPED_SQL = "m AS (SELECT l_returnflag || ' ' || lower(l_linestatus) || ' ' || l_quantity::INTEGER AS norm, l_partkey AS code, l_orderkey * 10 + l_linenumber AS ix FROM lineitem)"


def mapped(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    norm = F.concat_ws(" ", "l_returnflag", F.lower("l_linestatus"), F.col("l_quantity").cast("int").cast("string"))
    return line.select(norm.alias("norm"), F.col("l_partkey").alias("code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ix"))


@query("WITH " + MAPPED_SQL + " SELECT norm, max(code) AS code FROM m JOIN (SELECT norm, max(ix) AS ix FROM m WHERE code IN (SELECT p_partkey FROM part) GROUP BY norm) USING (norm, ix) GROUP BY norm")
def exact_map_last_wins(spark, sf_dir):
    rows = mapped(spark, sf_dir).groupBy("norm", "ix").agg(F.max("code").alias("code"))
    return retrieve.exact_map(rows, table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "code"))


VERIFIED_SQL = ", v AS (SELECT text AS norm, max(qid) AS verified FROM a GROUP BY text), w AS (SELECT a.qid, c.code AS verified FROM a JOIN v ON v.norm = a.text JOIN part ON p_partkey = v.verified JOIN c ON c.description = p_name)"


@query(JACCARD_SQL + VERIFIED_SQL + """, s AS (SELECT qid, code, CAST(trunc(sim * 400) AS INTEGER) AS score, rank FROM r WHERE rank <= 3),
    t AS (SELECT qid, max(score) AS top FROM s GROUP BY qid),
    u AS (SELECT s.qid, s.code, s.score, coalesce(s.code = w.verified, false) AS is_exact FROM s LEFT JOIN w USING (qid)
      UNION ALL SELECT w.qid, w.verified, coalesce(t.top + 1, 400), true FROM w LEFT JOIN t USING (qid) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.qid = w.qid AND s.code = w.verified)),
    x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY is_exact DESC, score DESC, code) AS rank FROM u),
    y AS (SELECT *, max(CASE WHEN NOT is_exact THEN score END) OVER (PARTITION BY qid) AS best FROM x WHERE rank <= 3)
    SELECT qid, code, CASE WHEN is_exact AND score < best THEN greatest(score, best + 1) ELSE score END AS score, is_exact, rank FROM y""")
def exact_override(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    a = asked(spark, sf_dir)
    rows = rank.ranked(jaccard_pairs(spark, sf_dir), 3, score="sim", tie="code").select("qid", "code", (F.col("sim") * 400).cast("int").alias("score"), "rank")
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("description")).join(cat, "description")
    maps = a.select(F.col("text").alias("norm"), F.col("qid").alias("ix")).join(names.select(F.col("key").alias("ix"), "code"), "ix")
    verified = retrieve.with_verified(a.select("qid", F.col("text").alias("norm")), retrieve.exact_map(maps, cat)).select("qid", "verified_code")
    out = rank.promote(rows, verified, cat.select("code"), 3, tie="code")
    return out.select("qid", "code", "score", "is_exact", F.col("rank").cast("bigint").alias("rank"))


@query("WITH " + CATALOG_SQL + """, s AS (SELECT s_suppkey AS qid, CASE s_nationkey % 4 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'PROMO' END AS block FROM supplier),
    u AS (SELECT qid, code, 0 AS pool FROM s JOIN c ON s.block = c.block OR s.block IS NULL UNION ALL SELECT s_suppkey, code, 1 FROM supplier JOIN c ON views = s_suppkey % 50)
    SELECT qid, code, min(pool) AS pool FROM u GROUP BY qid, code""")
def blocked_candidates(spark, sf_dir):
    n = F.col("s_nationkey") % 4
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.when(n == 0, "ECONOMY").when(n == 1, "LARGE").when(n == 2, "PROMO").alias("block"))
    cat = catalog(spark, sf_dir)
    by_views = sup.withColumn("views", (F.col("qid") % 50).cast("int")).join(cat.select("views", "code"), "views")
    return retrieve.candidates(retrieve.blocked(sup, cat.select("code", "block"), "block"), by_views)


def _tfidf_sql(docs: str, grams: str) -> str:
    return f"""d AS ({docs}), g AS ({grams}), f AS (SELECT id, term, count(*) AS tf FROM g GROUP BY id, term),
    v AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM f GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000),
    w AS (SELECT id, term, tf * idf AS w FROM f JOIN v USING (term)), z AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id),
    u AS (SELECT id, term, w / norm AS w FROM w JOIN z USING (id))"""


def _tfidf(docs: DataFrame, grams) -> DataFrame:
    counts = index.term_counts(docs, "id", grams)
    return index.weights(counts, index.vocabulary(counts, docs.count()), "id")


@query("WITH " + _tfidf_sql("SELECT item_id AS id, lower(text) AS t FROM benchmark", "SELECT id, unnest(list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n))) AS term FROM d, (VALUES (2), (3), (4)) AS k(n) WHERE length(t) >= n") + """
    SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS sim FROM u a JOIN u b USING (term) GROUP BY a.id, b.id""")
def char_ngram_tfidf(spark, sf_dir):
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    w = stash(_tfidf(docs, index.char_grams(F.col("text"))))
    sims = index.sparse_cosine(w.withColumnRenamed("id", "a"), w.withColumnRenamed("id", "b"), "a", "b")
    return sims.withColumn("sim", F.round("sim", 6))


@query("WITH " + _tfidf_sql("SELECT DISTINCT p_name || ' ' || lower(p_type) || ' ' || p_size AS t, t AS id FROM part", r"SELECT id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM (SELECT id, regexp_extract_all(t, '\b\w\w+\b') AS ws FROM d)") + """,
    q AS (SELECT * FROM u WHERE id IN (SELECT p_name || ' ' || lower(p_type) || ' ' || p_size FROM part WHERE p_partkey % 50 = 0)),
    s AS (SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS sim FROM q a JOIN u b USING (term) GROUP BY a.id, b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM s) SELECT a, b, sim, rank FROM r WHERE rank <= 3""")
def word_tfidf_cosine(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_name", F.lower("p_type"), F.col("p_size").cast("string"))
    docs = part.select(text.alias("id")).distinct()
    w = stash(_tfidf(docs, index.word_grams(F.col("id"))))
    asks = part.filter("p_partkey % 50 = 0").select(text.alias("id")).distinct()
    sims = index.sparse_cosine(w.join(asks, "id", "left_semi").withColumnRenamed("id", "a"), w.withColumnRenamed("id", "b"), "a", "b").withColumn("sim", F.round("sim", 6))
    return index.top_k(sims, "a", [F.desc("sim"), F.asc("b")], 3).withColumn("rank", F.col("rank").cast("bigint"))


DENSE_SQL = """WITH d AS (SELECT q.vec_id AS qid, q.label AS gold, i.vec_id AS code, i.label, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS sim
      FROM embeddings q JOIN embeddings i ON q.vec_id % 50 = 0 AND i.vec_id <> q.vec_id)"""


def dense(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asks = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("gold"), F.col("embedding").alias("qv"))
    rows = index.dense_pairs(asks, e.select(F.col("vec_id").alias("code"), "label", "embedding"), "qv", "embedding")
    return rows.filter("qid <> code").withColumn("sim", F.round("sim", 6))


@query(DENSE_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, code) AS rank FROM d) SELECT qid, code, sim, rank FROM r WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return index.top_k(dense(spark, sf_dir), "qid", [F.desc("sim"), F.asc("code")], 10).select("qid", "code", "sim", F.col("rank").cast("bigint").alias("rank"))


@query(DENSE_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, code) AS rank FROM d WHERE label = gold) SELECT qid, code, sim, rank FROM r WHERE rank <= 5")
def allowed_subset_topk(spark, sf_dir):
    return index.top_k(dense(spark, sf_dir).filter("label = gold"), "qid", [F.desc("sim"), F.asc("code")], 5).select("qid", "code", "sim", F.col("rank").cast("bigint").alias("rank"))


@query(DENSE_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, code) AS rank FROM d)
    SELECT qid, max(sim) FILTER (rank = 1) AS top, round(max(sim) FILTER (rank = 1) - coalesce(max(sim) FILTER (rank = 2), 0), 6) AS margin FROM r WHERE rank <= 2 GROUP BY qid""")
def margin_top2(spark, sf_dir):
    return rank.margin(dense(spark, sf_dir), score="sim", tie="code").withColumn("margin", F.round("margin", 6))


@query(JACCARD_SQL + """, s AS (SELECT qid, max(CAST(trunc(sim * 400) AS INTEGER)) AS top_score FROM r WHERE rank <= 3 GROUP BY qid)
    SELECT qid, 220 AS min_score, top_score, top_score >= 220 AS top_ok, CASE WHEN top_score < 220 THEN top_score END AS rejected_score, top_score < 220 AS needs_review FROM s""")
def threshold_gate(spark, sf_dir):
    rows = rank.ranked(jaccard_pairs(spark, sf_dir), 3, score="sim", tie="code").withColumn("score", (F.col("sim") * 400).cast("int"))
    return rank.annotate(rows).withColumn("needs_review", rank.needs_review(F.col("top_score"), F.lit(False), 220))


@query(JACCARD_SQL + " SELECT qid, code, rank FROM r WHERE rank <= 3 AND block = 'ECONOMY'")
def postlimit_filter(spark, sf_dir):
    rows = rank.ranked(jaccard_pairs(spark, sf_dir), 3, score="sim", tie="code").join(small(catalog(spark, sf_dir).select("code", "block")), "code")
    return rank.only_modality(rows, "ECONOMY", "block").select("qid", "code", F.col("rank").cast("bigint").alias("rank"))


@query("WITH " + CATALOG_SQL + " SELECT code, description, block FROM c WHERE upper(description) NOT IN ('UNCLASSIFIED', 'PRIOR', 'OTHER PRIOR') AND (block = 'ECONOMY' OR NOT EXISTS (SELECT 1 FROM c WHERE block = 'ECONOMY'))")
def narrow_catalog(spark, sf_dir):
    return rank.narrow(catalog(spark, sf_dir), "ECONOMY", "block").select("code", "description", "block")


@query("""SELECT o_orderkey, coalesce(c_mktsegment, n_name) AS modality FROM orders LEFT JOIN (SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN c_mktsegment END AS c_mktsegment FROM customer) ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = o_custkey % 25""")
def first_known_modality(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("code"))
    model = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.when(F.col("c_nationkey") < 12, F.col("c_mktsegment")).alias("c_mktsegment"))
    fallback = orders.select("code").distinct().withColumn("n_nationkey", (F.col("code") % 25).cast("int")).join(table(spark, sf_dir, "nation"), "n_nationkey")
    return retrieve.first_known(orders, (model, "c_mktsegment"), (fallback, "n_name")).select("o_orderkey", "modality")


# --- learning -------------------------------------------------------------------------


@query(DENSE_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, code) AS near FROM d),
    h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY near) AS pick FROM n WHERE near <= 20 AND label // 5 = gold // 5 AND label <> gold)
    SELECT qid, code, sim, pick FROM h WHERE pick <= 3""")
def hard_negatives(spark, sf_dir):
    rows = learn.hard_negatives(dense(spark, sf_dir), "qid", "code", F.floor(F.col("label") / 5) == F.floor(F.col("gold") / 5), F.col("label") == F.col("gold"))
    return rows.select("qid", "code", "sim", F.col("pick").cast("bigint").alias("pick"))


@query(DENSE_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, code) AS rank FROM d) SELECT qid, code, rank FROM r WHERE rank <= 5 AND label <> gold")
def wrong_predictions(spark, sf_dir):
    rows = learn.wrong_predictions(dense(spark, sf_dir), "qid", "code", F.col("label") == F.col("gold"), "sim", 5)
    return rows.select("qid", "code", F.col("rank").cast("bigint").alias("rank"))


@query(JACCARD_SQL + """, l AS (SELECT qid, code, CASE WHEN rank = 1 THEN 1 ELSE 0 END AS label, md5(qid::VARCHAR || ':' || code::VARCHAR || ':42') AS h FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY h, code) AS k FROM l) SELECT qid, code, label FROM n WHERE label = 1 OR k <= 5""")
def negative_sampling(spark, sf_dir):
    rows = rank.ranked(jaccard_pairs(spark, sf_dir), 10**6, score="sim", tie="code").select("qid", "code", F.when(F.col("rank") == 1, 1).otherwise(0).alias("label"))
    return learn.negatives(rows, most=5)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS k, count(*) OVER () AS n FROM documents)
    SELECT doc_id, k <= least(n, greatest(50, CAST(floor(0.1::DOUBLE * n) AS BIGINT))) AS held FROM r""")
def holdout_split(spark, sf_dir):
    train, held = learn.holdout(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return train.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))


def _graded(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Pairs of vectors with a label (same group) and a few features."""
    rows = dense(spark, sf_dir).select("qid", "code", (F.col("label") == F.col("gold")).cast("int").alias("label"), F.col("sim").alias("f_sim"), (F.abs(F.col("qid") - F.col("code")) / 1000).alias("f_far"), F.col("code").alias("code_ix"))
    return learn.negatives(rows, most=29), ["f_sim", "f_far"]


@query()
def ltr_pairwise(spark, sf_dir):
    rows, names = _graded(spark, sf_dir)
    rows = stash(rows)
    return rank.ranked(learn.fit_ranker(rows, names).score(rows), 5, score="raw").select("qid", "code", "raw", "rank", "label")


@query()
def isotonic_calibration(spark, sf_dir):
    rows, names = _graded(spark, sf_dir)
    rows = stash(rows)
    ranker = learn.fit_ranker(rows, names)
    scored = ranker.score(rows)
    first = rank.ranked(scored, 1, score="raw").select("qid", F.col("label").alias("correct"))
    margins = rank.margin(scored, score="raw").join(first, "qid")
    return learn.calibrate(ranker, margins, least=5).confidence(margins)


@query()
def rf_legacy(spark, sf_dir):
    rows, names = _graded(spark, sf_dir)
    rows = stash(rows)
    return learn.forest_scores(learn.fit_forest(rows, names, trees=20, depth=8), rows).select("qid", "code", "label", "proba")


# --- aliases, mappings, catalog and history -------------------------------------------


@query("WITH " + MAPPED_SQL + " SELECT code, array_to_string(list_sort(list_distinct(flatten(list(string_split(norm, ' '))))), ' ') AS tokens FROM m GROUP BY code")
def alias_tokens(spark, sf_dir):
    return index.alias_tokens(mapped(spark, sf_dir)).select("code", F.array_join("alias_tokens", " ").alias("tokens"))


@query("WITH " + MAPPED_SQL + """, f AS (SELECT code, lower(norm) AS low, min({'ix': ix, 'norm': norm}) AS x FROM m GROUP BY code, low),
    l AS (SELECT code, string_agg(x.norm, ' | ' ORDER BY x.ix, x.norm) AS names FROM f GROUP BY code)
    SELECT p_partkey AS code, p_name || coalesce(' | ' || names, '') AS text FROM part LEFT JOIN l ON code = p_partkey""")
def alias_text(spark, sf_dir):
    cat = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("description"))
    return index.alias_text(cat, mapped(spark, sf_dir))


@query("SELECT l_partkey AS code, count(*) AS n_train FROM lineitem GROUP BY 1")
def train_counts(spark, sf_dir):
    return index.train_counts(table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "code"))


@query("""WITH n AS (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey), l AS (SELECT list_sort(list(n)) AS x FROM n)
    SELECT x[1] AS least, x[len(x) // 2 + 1] AS median, x[len(x)] AS most FROM l""")
def mapping_stats(spark, sf_dir):
    return index.mapping_stats(table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "code"))


@query("""WITH b AS (SELECT o_custkey AS key, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY 1)
    SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey NOT IN (SELECT key FROM b) UNION ALL SELECT key, value FROM b""")
def upsert_merge(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("ix"))
    return tables.upsert(old, new, "key", "ix")


@query("""WITH o AS (SELECT DISTINCT upper(p_name) AS k FROM part WHERE p_size < 2), b AS (SELECT DISTINCT upper(p_name) AS k FROM part)
    SELECT count(*) FILTER (b.k NOT IN (SELECT k FROM o)) AS added, count(*) FILTER (b.k IN (SELECT k FROM o)) AS updated FROM b""")
def bulk_dedupe(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("key", rewrite.mapping_key(F.col("p_name")))
    old = part.withColumn("key", F.when(F.col("p_size") < 2, F.col("key")))  # other rows are not there yet
    return tables.upsert_counts(old, part, "key")


@query("""SELECT p_name AS name, p_type AS code FROM (SELECT DISTINCT p_name, p_type FROM part WHERE p_size < 20) UNION ALL
    SELECT name, code FROM (SELECT min(upper(p_name)) AS name, p_type AS code FROM part WHERE p_size >= 20 GROUP BY lower(p_name), p_type)
    WHERE (lower(name), code) NOT IN (SELECT (lower(p_name), p_type) FROM part WHERE p_size < 20)""")
def antijoin_append(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old = part.filter("p_size < 20").select(F.col("p_name").alias("name"), F.col("p_type").alias("code")).distinct()
    new = part.filter("p_size >= 20").select(F.upper("p_name").alias("name"), F.col("p_type").alias("code"))
    return tables.append_absent(old, new, [F.lower(F.trim("name")), F.col("code")])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY upper(trim(p_name)) ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, p_name FROM r WHERE n = 1""")
def catalog_upload(spark, sf_dir):
    return tables.upload(None, table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS code, coalesce(p_name, '') AS description FROM lineitem LEFT JOIN part ON CASE WHEN p_size < 40 THEN p_partkey END = l_partkey")
def mapping_listing(spark, sf_dir):
    cat = table(spark, sf_dir, "part").select(F.when(F.col("p_size") < 40, F.col("p_partkey")).alias("code"), F.col("p_name").alias("description"))
    return readers.mapping_listing(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("code")), cat)


@query("SELECT (SELECT count(*) FROM part) AS codes, (SELECT count(*) FROM lineitem) AS mappings")
def health_counts(spark, sf_dir):
    return tables.health(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"))


def history(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("query"), F.col("user_id").alias("normalized"),
        F.col("event_type").alias("code"), F.col("props").alias("description"), F.when(F.col("value") > 30, "EXACT_MATCH").when(F.col("value") > 3, "RULES").alias("method"),
        F.lit(None).cast("string").alias("corrected_code"),
    )


HISTORY_SQL = "h AS (SELECT event_id AS id, ts AS created_at, user_id::VARCHAR AS query, user_id AS normalized, event_type AS code, props AS description, CASE WHEN value > 30 THEN 'EXACT_MATCH' WHEN value > 3 THEN 'RULES' END AS method FROM events)"


@query("SELECT event_id AS id, ts, value FROM events ORDER BY event_id DESC LIMIT 3000")
def history_retention(spark, sf_dir):
    return tables.retain(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "value"))


@query("WITH " + HISTORY_SQL + " SELECT id, query, code FROM h ORDER BY id DESC LIMIT 200 OFFSET 100")
def history_page(spark, sf_dir):
    return tables.page(history(spark, sf_dir), 200, 100).select("id", "query", "code")


@query("WITH " + HISTORY_SQL + " SELECT query, code, description FROM h WHERE method NOT IN ('EXACT_MATCH', '') ORDER BY id DESC LIMIT 5000")
def history_export(spark, sf_dir):
    return tables.export(history(spark, sf_dir))


@query("""WITH m AS (SELECT max(ts) AS now FROM events), s AS (SELECT count(*) AS total, count(*) FILTER (ts >= now - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (ts >= now - INTERVAL 24 HOUR) AS last_day FROM events, m)
    SELECT total, last_hour, last_day, round(last_day / 24, 1) AS per_hour, round(last_hour / 60, 1) AS per_minute FROM s""")
def history_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return tables.stats(e.join(F.broadcast(e.agg(F.max("ts").alias("now")))), F.col("now"))


@query("WITH " + HISTORY_SQL + """, l AS (SELECT normalized, arg_max(id, (created_at, id)) AS id, arg_max(code, (created_at, id)) AS code FROM h GROUP BY 1),
    k AS (SELECT normalized, id FROM l WHERE code <> 'purchase')
    SELECT h.id, h.code, CASE WHEN k.id IS NOT NULL THEN 'purchase' END AS corrected_code FROM h LEFT JOIN k USING (id)""")
def correction_backfill(spark, sf_dir):
    h = history(spark, sf_dir)
    right = h.select("normalized").distinct().withColumn("code", F.lit("purchase"))
    return tables.backfill(h, right).select("id", "code", "corrected_code")


@query("SELECT min(value) AS least, avg(value) AS mean, max(value) AS most, count(*) FILTER (event_type = 'click') AS hits FROM events")
def latency_summary(spark, sf_dir):
    out = tables.latency(table(spark, sf_dir, "events").withColumn("hit", F.col("event_type") == "click"), "value")
    return out


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS code, 0.5::DOUBLE AS confidence FROM events
    WHERE json_extract(props, '$.k')::BIGINT IN (SELECT p_partkey FROM part WHERE p_size < 30)""")
def json_guard(spark, sf_dir):
    text = F.concat(F.lit("Sure: "), F.regexp_replace("props", '"k"', '"code"'), F.lit(" {or not}"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("qid"), suggest.read_answer(suggest.first_object(text)).alias("a"))
    rows = rows.select("qid", F.col("a.code").cast("bigint").alias("code"), F.col("a.confidence").alias("confidence"))
    allowed = table(spark, sf_dir, "part").select(F.when(F.col("p_size") < 30, F.col("p_partkey")).alias("code"))
    own = rows.select("qid", "code").join(allowed, "code", "left_semi")
    return suggest.guarded(rows, own).select(F.col("qid").alias("event_id"), "code", "confidence")


@query("WITH " + CATALOG_SQL + r"""
    SELECT block AS qid, 'Pick the catalog row that fits.' || chr(10) || 'Description: ' || block || chr(10) || 'Answer {"code": ..., "confidence": 0..1}.' || chr(10)
      || 'code' || chr(9) || 'description' || chr(9) || 'modality' || chr(10) || string_agg(code || chr(9) || description || chr(9) || block, chr(10) ORDER BY code) AS prompt FROM c GROUP BY block""")
def suggestion_prompts(spark, sf_dir):
    rows = catalog(spark, sf_dir).withColumn("qid", F.col("block")).withColumn("query", F.col("block"))
    return suggest.prompts(rows, modality="block", most=10**6)


# --- generated variants ---------------------------------------------------------------

TOY_RULES = ((r"\bhot\b", ("warm", "heated")), (r"\bbolt\b", ("screw",)), (r"\b(red|blue)\b", (r"\1dish",)), (r"\bplate\b", ("sheet", "tray")))
_RULES_SQL = r"""t(ord, p, r) AS (VALUES (0, '\bhot\b', 'warm'), (0, '\bhot\b', 'heated'), (1, '\bbolt\b', 'screw'), (2, '\b(red|blue)\b', '\1dish'), (3, '\bplate\b', 'sheet'), (3, '\bplate\b', 'tray')),
    o AS (SELECT code, description AS d, ord, regexp_replace(description, p, r, 'gi') AS v FROM c JOIN t ON regexp_matches(description, p, 'i'))"""


@query("WITH " + CATALOG_SQL + ", " + _RULES_SQL + " SELECT DISTINCT code, v AS variant FROM o WHERE lower(v) <> lower(d)")
def variant_depth1(spark, sf_dir):
    return generate.variants(catalog(spark, sf_dir), generate.rule_table(spark, TOY_RULES), depth=1)


@query("WITH " + CATALOG_SQL + ", " + _RULES_SQL + """, b AS (SELECT code, d, v FROM o UNION ALL SELECT code, d, regexp_replace(v, t.p, t.r, 'gi') FROM o JOIN t ON o.ord < t.ord AND regexp_matches(d, t.p, 'i')),
    u AS (SELECT DISTINCT code, v FROM b WHERE lower(v) <> lower(d)), k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY v) AS n FROM u)
    SELECT code, v AS variant FROM k WHERE n <= 8 UNION SELECT code, description FROM c""")
def variant_depth2(spark, sf_dir):
    return generate.training_pairs(catalog(spark, sf_dir), generate.rule_table(spark, TOY_RULES))


# --- streams --------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_feedback(spark, sf_dir):
    """Events arrive as files; each batch merges the latest one of every user into the state."""
    import uuid

    kind = table(spark, sf_dir, "events").schema
    base = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    stream = spark.readStream.schema(kind).parquet(f"{sf_dir}/events*.parquet").withColumn("order", F.struct("ts", "event_id"))
    last = []

    def merge(batch, batch_id, own=feedback.latest_merger(spark, f"{base}/state", "user_id", "order")):
        own(batch, batch_id)
        last.append(batch_id)

    feedback.apply_batches(stream, merge, f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/state/v={last[-1]}").select("user_id", "event_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def rolling_counts(spark, sf_dir):
    return feedback.rolling_counts(table(spark, sf_dir, "events"), by="event_type")


@query("SELECT upper(trim(event_type)) AS key, min(event_id) AS event_id FROM events GROUP BY 1")
def pending_first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("query"), F.col("event_id").alias("created_at"))
    out = suggest.enqueue(rows.limit(0), rows)
    return out.select(rewrite.review_key(F.col("query")).alias("key"), F.col("id").alias("event_id"))


# --- end to end -----------------------------------------------------------------------


BODIES, KINDS, SIDES = ("CHEST", "KNEE", "FOOT", "HEAD", "PELVIS", "HAND"), ("XR", "CT", "MR", "US"), ("N/A", "LEFT", "RIGHT")


def matched(spark, sf_dir) -> DataFrame:
    """Worded studies against a catalog with a code for each description that parts have: the queries are parts whose id is divisible by 50.

    A description is a study of a body part, with the part's size as views and its name behind; mappings verify every third code.
    """
    part = table(spark, sf_dir, "part")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_size") % len(values) + 1))
    body, kind, side = pick(BODIES), pick(KINDS), pick(SIDES)
    rows = part.groupBy("p_size", "p_name").agg(F.min("p_partkey").alias("ix")).select(
        "ix", F.col("ix").cast("string").alias("Code"), side.alias("Laterality"), F.lit("N/A").alias("Contrast"), F.col("p_size").cast("string").alias("XR#Views"),
        F.concat_ws(" ", kind, body, F.when(side != "N/A", side), F.concat(F.col("p_size").cast("string"), F.lit(" Views")), "p_name").alias("description"),
        kind.alias("modality"), body.alias("bodyRegion"), F.lit(None).cast("string").alias("long_description"),
    )
    cat = stash(readers.enrich_catalog(rows))
    maps = rows.filter("ix % 3 = 0").select(F.lower("description").alias("query"), F.col("Code").alias("code"), "ix").withColumn("norm", rewrite.normalize(F.col("query")))
    text = F.concat_ws(" ", F.lower(kind), body, F.when(side != "N/A", F.lower(side)), F.concat(F.col("p_size").cast("string"), F.lit(" views")), "p_name")
    other = F.concat_ws(" ", F.lower(kind), body, F.concat(F.col("p_size").cast("string"), F.lit("v")), F.substring_index("p_name", " ", -1))
    asks = part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.when(F.col("p_partkey") % 100 == 0, text).otherwise(other).alias("query"))
    return match.Matcher(cat, stash(maps)).match(asks, 5)


@query()
def match_end_to_end(spark, sf_dir):
    return matched(spark, sf_dir).select("qid", "original", "normalized", "rank", "code", "score", "method", "is_exact", "confidence", "needs_review")


@query()
def match_responses(spark, sf_dir):
    """One row for each query, with its matches and their score logs in order."""
    return match.responses(matched(spark, sf_dir))
