"""Record linkage rows: keys, blocked pairs, Jaro-Winkler, levels, weights,
probabilities, training, and the end-to-end bestseller match."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wreath.operators import linkage as LK
from wreath.operators import relational as R
from wreath.operators import similarity as SM
from wreath.plans import stages as S
from wreath.plans.fixtures import Fixtures
from wreath.plans.queries_text import _duck_name_key
from wreath.plans.registry import query

# Fixed weights for the SQL-checked rows: m and u per level (else, >=0.7,
# >=0.9, exact), and the prior match probability.
M_FIXED = {"title_level": (0.01, 0.02, 0.07, 0.9), "author_level": (0.05, 0.05, 0.1, 0.8)}
U_FIXED = {"title_level": (0.95, 0.0485, 0.001, 0.0005), "author_level": (0.7, 0.2, 0.095, 0.005)}
PRIOR = 0.0001
EM_ROUNDS = 3_000
COMPS = [LK.Comparison("title_level", "title_key_l", "title_key_r"),
         LK.Comparison("author_level", "author_key_l", "author_key_r")]
FIXED_MODEL = LK.LinkageModel(COMPS, M_FIXED, U_FIXED, PRIOR)


def _lvl_sql(l: str, r: str) -> str:
    return (f"CASE WHEN {l} IS NULL OR {r} IS NULL THEN -1 WHEN {l} = {r} THEN 3 "
            f"WHEN jaro_winkler_similarity({l}, {r}) >= 0.9 THEN 2 "
            f"WHEN jaro_winkler_similarity({l}, {r}) >= 0.7 THEN 1 ELSE 0 END")


def _bf_sql(col: str, name: str) -> str:
    parts = " ".join(f"WHEN {i} THEN CAST({math.log2(M_FIXED[name][i] / U_FIXED[name][i])!r} AS DOUBLE)"
                     for i in range(4))
    return f"CASE {col} {parts} ELSE CAST(0.0 AS DOUBLE) END"


PAIRS = f"""
ka AS (SELECT unique_id, {_duck_name_key('title')} AS title_key, {_duck_name_key('author')} AS author_key, year FROM catalog_a),
kb AS (SELECT unique_id, {_duck_name_key('title')} AS title_key, {_duck_name_key('author')} AS author_key, year FROM catalog_b),
pairs AS (SELECT a.unique_id AS unique_id_l, b.unique_id AS unique_id_r, b.year AS year_r,
                 a.title_key AS title_key_l, b.title_key AS title_key_r,
                 a.author_key AS author_key_l, b.author_key AS author_key_r
          FROM ka a JOIN kb b ON a.year = b.year - 1),
lv AS (SELECT *, {_lvl_sql('title_key_l', 'title_key_r')} AS title_level,
              {_lvl_sql('author_key_l', 'author_key_r')} AS author_level FROM pairs),
sc AS (SELECT *, CAST({math.log2(PRIOR / (1 - PRIOR))!r} AS DOUBLE) + {_bf_sql('title_level', 'title_level')}
                 + {_bf_sql('author_level', 'author_level')} AS match_weight FROM lv),
pr AS (SELECT *, 1.0 / (1.0 + pow(2.0, -match_weight)) AS match_probability FROM sc)"""


def _leveled(fx):
    """Levels of all candidate pairs; comparisons run on the blocks' tiles, no pair carries its keys."""
    keys = [S.linkage_keys(df).select("unique_id", "year", F.col("title_key").alias(f"title_key{s}"), F.col("author_key").alias(f"author_key{s}"))
            for df, s in ((fx.catalog_a, "_l"), (fx.catalog_b.withColumn("year", F.col("year") - 1), "_r"))]
    return SM.leveled_pairs(*keys, ("year", "year"), COMPS, ("unique_id", "unique_id"))


@query("j9_jaro_winkler", oracle="WITH " + PAIRS + """
SELECT DISTINCT title_key_l, title_key_r, round(jaro_winkler_similarity(title_key_l, title_key_r), 6) AS jw FROM pairs
""")
def j9_jaro_winkler(spark, sf):
    """Jaro-Winkler of every distinct pair of title keys: keys are made distinct by block before they meet."""
    fx = Fixtures(spark, sf)
    a, b = (S.linkage_keys(df).select("title_key", "year").distinct() for df in (fx.catalog_a, fx.catalog_b))
    d = R.blocked_pairs(a, b, F.col("year"), F.col("year") - 1).select("title_key_l", "title_key_r").distinct()
    return d.withColumn("jw", F.round(LK.jaro_winkler_udf("title_key_l", "title_key_r"), 6))


@query("j9_comparison_levels", oracle="WITH " + PAIRS + """
SELECT unique_id_l, unique_id_r, title_level, author_level FROM lv
""")
def j9_comparison_levels(spark, sf):
    """Jaro-Winkler comparison levels of every candidate pair."""
    return _leveled(Fixtures(spark, sf)).select("unique_id_l", "unique_id_r", "title_level", "author_level")


@query("j12_match_probability", oracle="WITH " + PAIRS + """
SELECT unique_id_l, unique_id_r, round(match_weight, 6) AS match_weight, round(match_probability, 6) AS match_probability FROM pr
""")
def j12_match_probability(spark, sf):
    """Match weight and probability of every candidate pair with fixed m and u."""
    s = LK.match_probability(_leveled(Fixtures(spark, sf)), FIXED_MODEL, digits=6)
    return s.select("unique_id_l", "unique_id_r", "match_weight", "match_probability")


@query("c8_probabilistic_linkage_join", oracle="WITH " + PAIRS + """
SELECT unique_id_l, unique_id_r, year_r FROM pr WHERE match_probability >= 0.9
""")
def c8_probabilistic_linkage_join(spark, sf):
    """Scored once per distinct key combination, expanded to records only
    where the probability reaches 0.9."""
    fx = Fixtures(spark, sf)
    return S.linked_pairs(fx.catalog_a, fx.catalog_b, FIXED_MODEL, 0.9).select("unique_id_l", "unique_id_r", "year_r")


@query("b16_score_threshold", oracle="WITH " + PAIRS + """
SELECT CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(*) FILTER (WHERE match_probability >= 0.9) AS BIGINT) AS n_matches FROM pr
""")
def b16_score_threshold(spark, sf):
    """Count of candidate pairs and of those with probability >= 0.9: the former
    from record counts by year, the latter from the similarity join; no pair is formed to count it."""
    fx = Fixtures(spark, sf)
    a = fx.catalog_a.groupBy("year").agg(F.count(F.lit(1)).alias("n_a"))
    b = fx.catalog_b.groupBy((F.col("year") - 1).alias("year")).agg(F.count(F.lit(1)).alias("n_b"))
    n = a.join(b, "year").agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).cast("bigint").alias("n_pairs"))
    hits = S.linked_pairs(fx.catalog_a, fx.catalog_b, FIXED_MODEL, 0.9).agg(F.count(F.lit(1)).cast("bigint").alias("n_matches"))
    return n.join(hits)


J26_SQL = "WITH " + PAIRS + """,
jt AS (SELECT DISTINCT unique_id_l AS title_id, unique_id_r AS work_id, year_r AS award_year FROM pr WHERE match_probability >= 0.9)
SELECT jt.work_id, max(r.rank) AS "max", CAST(count(r.rank) AS BIGINT) AS "count", median(r.rank) AS "median"
FROM jt JOIN ranks r ON r.title_id = jt.title_id
WHERE r.year < jt.award_year
GROUP BY jt.title_id, jt.work_id, r.year
"""


@query("j26_bestseller_match", oracle=J26_SQL)
def j26_bestseller_match(spark, sf):
    """Linkage with fixed weights, then max/count/median list rank before the award year."""
    fx = Fixtures(spark, sf)
    return S.bestseller_match(fx.catalog_a, fx.catalog_b, fx.ranks, model=FIXED_MODEL)


@query("j10_estimate_u")
def j10_estimate_u(spark, sf):
    """u per comparison level from ~200k seeded random pairs (rows-only)."""
    fx = Fixtures(spark, sf)
    u = LK.estimate_u(S.linkage_keys(fx.catalog_a), S.linkage_keys(fx.catalog_b), COMPS, 200_000, seed=1)
    return spark.createDataFrame([(k, i, float(v)) for k, arr in u.items() for i, v in enumerate(arr)],
                                 "comparison STRING, level INT, u DOUBLE")


def _em_factor(levels: str, level: str) -> str:
    return f"CASE WHEN {level} < 0 THEN 1 ELSE {levels}[{level} + 1] END"


# EM from the same start, written out as a recursion over one row: match share, m of both comparisons
J11_SQL = "WITH RECURSIVE " + PAIRS.lstrip() + f""",
hist AS (SELECT list({{t: title_level, a: author_level, n: CAST(n AS DOUBLE)}}) AS h, sum(n) AS total
         FROM (SELECT title_level, author_level, count(*) AS n FROM lv GROUP BY ALL)),
em AS (
  SELECT 0 AS k, CAST(0.001 AS DOUBLE) AS share, [0.01, 0.08, 0.27, 0.64]::DOUBLE[] AS mt, [0.01, 0.08, 0.27, 0.64]::DOUBLE[] AS ma
  UNION ALL
  SELECT k + 1, list_sum(list_transform(w, lambda x: x.w)) / total,
         list_transform([0, 1, 2, 3], lambda l: list_sum(list_transform(w, lambda x: CASE WHEN x.t = l THEN x.w ELSE 0 END)) / list_sum(list_transform(w, lambda x: CASE WHEN x.t >= 0 THEN x.w ELSE 0 END))),
         list_transform([0, 1, 2, 3], lambda l: list_sum(list_transform(w, lambda x: CASE WHEN x.a = l THEN x.w ELSE 0 END)) / list_sum(list_transform(w, lambda x: CASE WHEN x.a >= 0 THEN x.w ELSE 0 END)))
  FROM (SELECT k, total, list_transform(h, lambda x: {{t: x.t, a: x.a, w: x.n * share * ({_em_factor('mt', 'x.t')}) * ({_em_factor('ma', 'x.a')})
                 / (share * ({_em_factor('mt', 'x.t')}) * ({_em_factor('ma', 'x.a')})
                    + (1 - share) * ({_em_factor(repr(list(U_FIXED['title_level'])), 'x.t')}) * ({_em_factor(repr(list(U_FIXED['author_level'])), 'x.a')}))}}) AS w
        FROM em, hist WHERE k < {EM_ROUNDS}))
SELECT comparison, CAST(level AS INT) AS level, round(m, 5) AS m
FROM (SELECT 'title_level' AS comparison, unnest([0, 1, 2, 3]) AS level, unnest(mt) AS m FROM em WHERE k = {EM_ROUNDS}
      UNION ALL SELECT 'author_level', unnest([0, 1, 2, 3]), unnest(ma) FROM em WHERE k = {EM_ROUNDS})
"""


@query("j11_estimate_m", oracle=J11_SQL)
def j11_estimate_m(spark, sf):
    """m per level by EM on the blocked pairs' level histogram with u fixed; run until nothing moves."""
    fx = Fixtures(spark, sf)
    left, right = S.linkage_sides(fx.catalog_a, fx.catalog_b)
    hist = SM.level_histogram(left, right, ("year_l", "block"), COMPS, "n_l", "n_r")
    m, _ = LK.em_histogram(hist, COMPS, U_FIXED, max_iter=EM_ROUNDS, tol=1e-10)
    return spark.createDataFrame([(k, i, round(float(v), 5)) for k, arr in m.items() for i, v in enumerate(arr)],
                                 "comparison STRING, level INT, m DOUBLE")


@query("j11_level_histogram", oracle="WITH " + PAIRS + """
SELECT title_level, author_level, CAST(count(*) AS BIGINT) AS n FROM lv GROUP BY ALL
""")
def j11_level_histogram(spark, sf):
    """Level patterns of all blocked pairs, counted through similar keys instead of pairs."""
    fx = Fixtures(spark, sf)
    left, right = S.linkage_sides(fx.catalog_a, fx.catalog_b)
    hist = SM.level_histogram(left, right, ("year_l", "block"), COMPS, "n_l", "n_r")
    return spark.createDataFrame([(*p, n) for p, n in hist], "title_level INT, author_level INT, n BIGINT")


@query("j9_similar_words", oracle="""
WITH dw AS (SELECT DISTINCT unnest(string_split_regex(coalesce(text, ''), '[^A-Za-z]+')) AS w FROM documents),
bw AS (SELECT DISTINCT unnest(string_split_regex(coalesce(text, ''), '[^A-Za-z]+')) AS w FROM benchmark)
SELECT a.w AS word_l, b.w AS word_r, round(CASE WHEN a.w = b.w THEN 1.0 ELSE jaro_winkler_similarity(a.w, b.w) END, 6) AS sim
FROM dw a JOIN bw b ON a.w = b.w OR jaro_winkler_similarity(a.w, b.w) >= 0.9
WHERE a.w <> '' AND b.w <> ''
""")
def j9_similar_words(spark, sf):
    """Similarity join: every distinct ASCII word (SQL compares bytes) of the documents with every word of the benchmark texts that is
    equal to it or has a Jaro-Winkler similarity of 0.9, by an inverted index."""
    fx = Fixtures(spark, sf)

    def words(df):
        return df.select(F.explode(F.split(F.coalesce("text", F.lit("")), "[^A-Za-z]+")).alias("w")).where("w <> ''").distinct()

    found = SM.similar_keys(words(fx.table("documents")), words(fx.table("benchmark")), 0.9)
    return found.select(F.col("key_l").alias("word_l"), F.col("key_r").alias("word_r"), F.round("sim", 6).alias("sim"))


#: digits as consonants, for surnames made of numbers
SURNAME_LETTERS = "bcdfghklmn"


def _named(df):
    """Authors with a surname of their own, so that equal authors are rare by chance."""
    number = (F.col("unique_id") * 7919 % 99991).cast("string")
    return df.withColumn("author", F.concat(F.translate(number, "0123456789", SURNAME_LETTERS), F.lit(" "), F.col("author")))


def _lists_and_works_with_matches(fx):
    """Lists = catalog_a with surnames. Works = catalog_b with surnames plus a re-keyed
    copy of every third list title, awarded the year after its list year, every second
    copy's title altered (plural): true matches at every scale, some of them inexact."""
    lists = _named(fx.catalog_a)
    copies = lists.filter(F.col("unique_id") % 3 == 0).select(
        (F.col("unique_id") + 1_000_000_000).alias("unique_id"),
        F.when(F.col("unique_id") % 4 == 1, F.col("title")).otherwise(F.concat("title", F.lit("s"))).alias("title"),
        "author", (F.col("year") + 1).alias("year"))
    return lists, _named(fx.catalog_b).unionByName(copies)


@query("j26_bestseller_match_trained")
def j26_bestseller_match_trained(spark, sf):
    """End to end with a trained model: u by random pairs, m and the share of
    matches by EM on the blocked pairs, then the rank statistics (rows-only)."""
    fx = Fixtures(spark, sf)
    lists, works = _lists_and_works_with_matches(fx)
    return S.bestseller_match(lists, works, fx.ranks, seed=1, prior=None)


@query("j26_trained_links", oracle="""
SELECT CAST(unique_id AS BIGINT) AS unique_id, CAST(unique_id + 1000000000 AS BIGINT) AS copy_id, true AS found
FROM catalog_a WHERE unique_id % 3 = 0
""")
def j26_trained_links(spark, sf):
    """Which planted copies the trained model links to their originals: all of them are."""
    fx = Fixtures(spark, sf)
    lists, works = _lists_and_works_with_matches(fx)
    model = S.train_linkage(lists, works, COMPS, seed=1, prior=None)
    links = S.linked_pairs(lists, works, model, 0.9).select(F.col("unique_id_l").cast("bigint").alias("unique_id"),
                                                            F.col("unique_id_r").cast("bigint").alias("copy_id"), F.lit(True).alias("found"))
    planted = lists.filter(F.col("unique_id") % 3 == 0).select(
        F.col("unique_id").cast("bigint").alias("unique_id"), (F.col("unique_id") + 1_000_000_000).cast("bigint").alias("copy_id"))
    return planted.join(links, ["unique_id", "copy_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query("j26_nominated_works", oracle=f"""
WITH f AS (SELECT work_id, author_label, min([ok, CAST(ln AS BIGINT), author_id]) AS p FROM nom GROUP BY ALL),
a AS (SELECT work_id, string_agg(author_label, ' ' ORDER BY p) AS author FROM f GROUP BY work_id),
t AS (SELECT work_id, title, year FROM nom
      QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY ok, ln, author_id) = 1)
SELECT t.work_id AS unique_id, t.title, a.author, t.year,
       {_duck_name_key('t.title')} AS title_key, {_duck_name_key('a.author')} AS author_key
FROM t JOIN a USING (work_id)
""")
def j26_nominated_works(spark, sf):
    """The works side built from award records: distinct co-author names in
    first-seen order, first title and year per work, then the name keys."""
    return S.linkage_keys(S.nominated_works(Fixtures(spark, sf).nom))


@query("j12_match_probability_trained")
def j12_match_probability_trained(spark, sf):
    """The pairs that the trained model links, with their probability (rows-only)."""
    fx = Fixtures(spark, sf)
    lists, works = _lists_and_works_with_matches(fx)
    model = S.train_linkage(lists, works, COMPS, seed=1, prior=None)
    return S.linked_pairs(lists, works, model, 0.9)
