"""Nomination path: dedup, counts, as-of prior totals, biography, features, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from wreath.functions.aggregates import count_where, mode_of
from wreath.operators.relational import (
    asof_join,
    cohort_share,
    cohort_total,
    group_all_but,
    temporal_split,
)
from wreath.plans import stages as S
from wreath.plans.fixtures import Fixtures
from wreath.plans.registry import query
from wreath.session import materialize

# ---------------------------------------------------------------- oracle CTEs
DEDUP = """
dedup AS (
  SELECT * EXCLUDE (openlibrary_id, isbn, article) FROM nom
  QUALIFY row_number() OVER (PARTITION BY work_id, author_id, award
    ORDER BY pub_date ASC NULLS LAST, CASE WHEN status = 'winner' THEN 0 ELSE 1 END, year, ok, ln) = 1)"""

WORKS = DEDUP + """,
yc AS (
  SELECT title, work_id, author_label, author_id, pub_date, goodreads_id, year, count(*) AS c
  FROM dedup GROUP BY ALL),
ym AS (
  SELECT * FROM yc QUALIFY row_number() OVER (
    PARTITION BY title, work_id, author_label, author_id, pub_date, goodreads_id
    ORDER BY c DESC, year ASC) = 1),
grp AS (
  SELECT title, work_id, author_label, author_id, pub_date, goodreads_id,
         CAST(count(*) FILTER (WHERE status = 'nominated') AS BIGINT) AS n_nom,
         CAST(count(*) FILTER (WHERE status = 'winner') AS BIGINT) AS n_win
  FROM dedup GROUP BY ALL),
works AS (
  SELECT g.*, CAST(m.year AS INT) AS year FROM grp g JOIN ym m
    ON g.work_id = m.work_id AND g.author_id = m.author_id
   AND g.title IS NOT DISTINCT FROM m.title AND g.author_label IS NOT DISTINCT FROM m.author_label
   AND g.pub_date IS NOT DISTINCT FROM m.pub_date AND g.goodreads_id IS NOT DISTINCT FROM m.goodreads_id)"""

CLEAN = WORKS + """,
cum AS (
  SELECT author_id, author_label, year,
         sum(n) OVER (PARTITION BY author_id ORDER BY year) AS awards_as_of_year
  FROM (SELECT author_id, author_label, year, count(award) AS n FROM awards GROUP BY ALL)),
prior AS (
  SELECT w.work_id, w.author_id, arg_max(c.awards_as_of_year, c.year) AS awards_as_of_year
  FROM works w JOIN cum c ON c.author_id = w.author_id AND c.year < w.year
  GROUP BY w.work_id, w.author_id),
info AS (
  SELECT w.work_id, w.author_id,
         CAST(w.year - year(try_strptime(b.dob, '%Y-%m-%dT%H:%M:%SZ')) AS INT) AS age,
         b.birth_country, b.gender
  FROM works w JOIN bio b ON b.author_id = w.author_id),
clean AS (
  SELECT w.*, CAST(coalesce(p.awards_as_of_year, 0) AS INT) AS awards_as_of_year,
         i.age, i.birth_country, i.gender
  FROM works w
  LEFT JOIN prior p ON p.work_id = w.work_id AND p.author_id = w.author_id
  LEFT JOIN info i ON i.work_id = w.work_id AND i.author_id = w.author_id)"""

STATS = """
stats AS (
  SELECT title_id AS work_id, max(rank) AS "max", CAST(count(rank) AS BIGINT) AS "count",
         median(rank) AS "median"
  FROM ranks GROUP BY title_id)"""

LIST_ORDER = "author_id NULLS LAST, gender NULLS LAST, birth_country NULLS LAST, age NULLS LAST"

FEATURES = CLEAN + "," + STATS + f""",
merged AS (SELECT c.*, s."max", s."count", s."median" FROM clean c LEFT JOIN stats s USING (work_id)),
author_data AS (
  SELECT work_id, avg(age) AS mean_age,
         list(gender ORDER BY {LIST_ORDER}) AS gender,
         list(birth_country ORDER BY {LIST_ORDER}) AS birth_country,
         CAST(sum(awards_as_of_year) AS BIGINT) AS awards_as_of_year
  FROM merged GROUP BY work_id),
first_rows AS (
  SELECT * EXCLUDE (age, gender, awards_as_of_year, birth_country) FROM merged
  QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY author_id) = 1),
features AS (
  SELECT f.title, f.work_id, f.author_label, f.author_id, f.goodreads_id, f.year, f.n_win,
         f.n_nom + f.n_win AS n_nom_all,
         coalesce(f."max", 0) AS max_bestseller_rank,
         coalesce(f."count", 0) AS months_on_bestseller,
         coalesce(f."median", 0) AS median_bestseller_rank,
         CAST(month(try_strptime(f.pub_date, '%Y-%m-%dT%H:%M:%SZ')) AS INT) AS month,
         a.mean_age, a.gender, a.birth_country, a.awards_as_of_year
  FROM first_rows f LEFT JOIN author_data a USING (work_id))"""


def _stats(fx):
    return fx.ranks.groupBy(F.col("title_id").alias("work_id")).agg(
        F.max("rank").alias("max"), F.count("rank").cast("bigint").alias("count"),
        F.median("rank").alias("median"))


def _clean(fx, cluster_by=None):
    return S.clean_nominations(fx.nom, fx.awards, fx.bio, cluster_by=cluster_by)


# ---------------------------------------------------------------- A16
@query("a16_identifier_table", oracle="""
SELECT work_id, openlibrary_id FROM nom
WHERE work_id IS NOT NULL AND openlibrary_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY openlibrary_id ORDER BY work_id) = 1
""")
def a16_identifier_table(spark, sf):
    """(work, OpenLibrary id) side table: nulls dropped, first work per id."""
    return S.identifier_table(Fixtures(spark, sf).nom, "openlibrary_id")


@query("a16_identifier_table_url", oracle="""
SELECT work_id, article FROM nom
WHERE work_id IS NOT NULL AND article IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY article ORDER BY work_id) = 1
""")
def a16_identifier_table_url(spark, sf):
    """(work, article URL) side table: nulls dropped, first work per URL."""
    return S.identifier_table(Fixtures(spark, sf).nom, "article")


# ---------------------------------------------------------------- D13 / Q4
@query("d13_dedup_first", oracle="WITH " + DEDUP + " SELECT * FROM dedup")
def d13_dedup_first(spark, sf):
    """One record per (work, author, award): earliest date, winner first, year, key."""
    return S.dedup_award_records(Fixtures(spark, sf).nom)


# ---------------------------------------------------------------- D3
@query("d3_mode_smallest_tie", oracle="""
WITH yc AS (SELECT work_id, year, count(*) AS c FROM nom GROUP BY ALL)
SELECT work_id, year AS modal_year FROM yc
QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY c DESC, year ASC) = 1
""")
def d3_mode_smallest_tie(spark, sf):
    """Most frequent year per work, smallest on a tie."""
    return Fixtures(spark, sf).nom.groupBy("work_id").agg(mode_of("year").alias("modal_year"))


# ---------------------------------------------------------------- D2
@query("d2_conditional_counts", oracle="""
SELECT work_id,
       CAST(count(*) FILTER (WHERE status = 'nominated') AS BIGINT) AS n_nom,
       CAST(count(*) FILTER (WHERE status = 'winner') AS BIGINT) AS n_win
FROM nom GROUP BY work_id
""")
def d2_conditional_counts(spark, sf):
    """Nominated and winner counts per work."""
    return Fixtures(spark, sf).nom.groupBy("work_id").agg(
        count_where(F.col("status") == "nominated").alias("n_nom"),
        count_where(F.col("status") == "winner").alias("n_win"))


# ---------------------------------------------------------------- B3 / D4
@query("d4_null_keeping_group", oracle="""
SELECT work_id, goodreads_id, pub_date, CAST(count(*) AS BIGINT) AS n
FROM (SELECT work_id, goodreads_id, pub_date FROM nom) GROUP BY ALL
""")
def d4_null_keeping_group(spark, sf):
    """Grouping that keeps null keys as their own group."""
    t = Fixtures(spark, sf).nom.select("work_id", "goodreads_id", "pub_date", "status")
    return group_all_but(t, ["status"], [F.count(F.lit(1)).cast("bigint").alias("n")])


@query("b3_all_but_keys", oracle="WITH " + WORKS + " SELECT * FROM works")
def b3_all_but_keys(spark, sf):
    """Group by every column except award, status and year (modal year, counts)."""
    return S.nomination_counts(S.dedup_award_records(Fixtures(spark, sf).nom))


# ---------------------------------------------------------------- C6
@query("c6_asof_join", oracle="WITH " + CLEAN + """
SELECT w.work_id, w.author_id, w.year, CAST(coalesce(p.awards_as_of_year, 0) AS BIGINT) AS awards_as_of_year
FROM works w LEFT JOIN prior p ON p.work_id = w.work_id AND p.author_id = w.author_id
""")
def c6_asof_join(spark, sf):
    """Prior cumulative award total strictly before the award year (join + max_by), default 0."""
    fx = Fixtures(spark, sf)
    works = S.nomination_counts(S.dedup_award_records(fx.nom)).select("work_id", "author_id", "year")
    totals = S.cumulative_awards(fx.awards).select("author_id", "year", "awards_as_of_year")
    return asof_join(works, totals, "author_id", "year", "year", "awards_as_of_year", default=0) \
        .withColumn("awards_as_of_year", F.col("awards_as_of_year").cast("bigint"))


@query("c6_asof_join_window", oracle="WITH " + CLEAN + """
SELECT w.work_id, w.author_id, w.year, CAST(coalesce(p.awards_as_of_year, 0) AS BIGINT) AS awards_as_of_year
FROM works w LEFT JOIN prior p ON p.work_id = w.work_id AND p.author_id = w.author_id
""")
def c6_asof_join_window(spark, sf):
    """The same as-of lookup through sorted ranges that carry the last total on."""
    fx = Fixtures(spark, sf)
    works = S.nomination_counts(S.dedup_award_records(fx.nom)).select("work_id", "author_id", "year")
    totals = S.cumulative_awards(fx.awards).select("author_id", "year", "awards_as_of_year")
    return asof_join(works, totals, "author_id", "year", "year", "awards_as_of_year", default=0,
                     method="scan") \
        .withColumn("awards_as_of_year", F.col("awards_as_of_year").cast("bigint"))


# ---------------------------------------------------------------- C1 / I11
@query("c1_inner_join_bio", oracle="WITH " + CLEAN + " SELECT * FROM info")
def c1_inner_join_bio(spark, sf):
    """Works joined to biographies on author (several rows per author kept)."""
    fx = Fixtures(spark, sf)
    works = S.nomination_counts(S.dedup_award_records(fx.nom)).select("work_id", "author_id", "year")
    return S.author_biography(works, fx.bio)


@query("i11_parse_timestamp_rejects", oracle="""
SELECT CAST(count(*) FILTER (WHERE dob IS NOT NULL AND try_strptime(dob, '%Y-%m-%dT%H:%M:%SZ') IS NULL) AS BIGINT) AS rejected,
       CAST(count(try_strptime(dob, '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT) AS parsed,
       CAST(min(year(try_strptime(dob, '%Y-%m-%dT%H:%M:%SZ'))) AS INT) AS first_year
FROM bio
""")
def i11_parse_timestamp_rejects(spark, sf):
    """ISO dates parsed with a format; unparseable values counted instead of failing."""
    ts = F.try_to_timestamp(F.col("dob"), F.lit(S.ISO_Z))
    return Fixtures(spark, sf).bio.agg(
        count_where(F.col("dob").isNotNull() & ts.isNull()).alias("rejected"),
        F.count(ts).cast("bigint").alias("parsed"),
        F.min(F.year(ts)).cast("int").alias("first_year"))


# ---------------------------------------------------------------- J28 (flagship)
@query("j28_clean_nominations", oracle="WITH " + CLEAN + " SELECT * FROM clean")
def j28_clean_nominations(spark, sf):
    """The nomination table: dedup, counts, prior awards (as-of), biography."""
    return _clean(Fixtures(spark, sf))


# ---------------------------------------------------------------- C3 / G4
@query("c3_left_join_features", oracle="WITH " + CLEAN + "," + STATS + """
SELECT c.*, s."max", s."count", s."median" FROM clean c LEFT JOIN stats s USING (work_id)
""")
def c3_left_join_features(spark, sf):
    """Nomination table left-joined with per-work list statistics."""
    fx = Fixtures(spark, sf)
    return _clean(fx, ["work_id"]).join(_stats(fx), "work_id", "left")


@query("g4_temporal_split", oracle="WITH " + CLEAN + """
SELECT 'train' AS split, * FROM clean WHERE year >= 1995 AND year < 1999
UNION ALL
SELECT 'test' AS split, * FROM clean WHERE year >= 1999 AND year < 2001
""")
def g4_temporal_split(spark, sf):
    """Nomination table split into train [1995, 1999) and test [1999, 2001)."""
    train, test = temporal_split(materialize(_clean(Fixtures(spark, sf))), "year", (1995, 1999), (1999, 2001))
    return (train.select(F.lit("train").alias("split"), "*")
            .unionByName(test.select(F.lit("test").alias("split"), "*")))


# ---------------------------------------------------------------- J18 / J19 / J17
@query("j18_reduce_authors", oracle="WITH " + FEATURES + """
SELECT f.*, a.mean_age, a.gender, a.birth_country, a.awards_as_of_year
FROM first_rows f LEFT JOIN author_data a USING (work_id)
""")
def j18_reduce_authors(spark, sf):
    """One row per work: mean age, gender and country lists, summed prior awards."""
    fx = Fixtures(spark, sf)
    return S.work_profiles(_clean(fx, ["work_id"]).join(_stats(fx), "work_id", "left"))


@query("j19_fix_nom_counts", oracle="WITH " + CLEAN + """
SELECT * EXCLUDE (n_nom), n_nom + n_win AS n_nom_all FROM clean
""")
def j19_fix_nom_counts(spark, sf):
    """n_nom_all = n_nom + n_win, n_nom dropped."""
    return _clean(Fixtures(spark, sf)).withColumn("n_nom_all", S.all_nominations()).drop("n_nom")


@query("j17_cohort_features", oracle="WITH " + FEATURES + """
SELECT *, sum(n_nom_all) OVER (PARTITION BY year) AS tot_cohort_nom,
       sum(n_win) OVER (PARTITION BY year) AS tot_cohort_awards
FROM features
""")
def j17_cohort_features(spark, sf):
    """Model features: authors reduced, totals, list columns, month, cohort totals."""
    fx = Fixtures(spark, sf)
    return S.cohort_features(_clean(fx, ["work_id"]).join(_stats(fx), "work_id", "left"))


# ---------------------------------------------------------------- E2 / E4 / C4
@query("e2_partition_total", oracle="""
SELECT *, sum(n_nom_all) OVER (PARTITION BY year) AS tot_cohort_nom,
       sum(n_win) OVER (PARTITION BY year) AS tot_cohort_awards FROM cohort
""")
def e2_partition_total(spark, sf):
    """Cohort totals of nominations and wins on every row."""
    c = Fixtures(spark, sf).cohort
    return cohort_total(cohort_total(c, "year", "n_nom_all", "tot_cohort_nom"),
                        "year", "n_win", "tot_cohort_awards")


@query("c4_full_outer_totals", oracle="""
SELECT c.*, t.tot_cohort_nom, t.tot_cohort_awards
FROM cohort c FULL JOIN (SELECT year, sum(n_nom_all) AS tot_cohort_nom, sum(n_win) AS tot_cohort_awards
                         FROM cohort GROUP BY year) t USING (year)
""")
def c4_full_outer_totals(spark, sf):
    """Cohort totals attached with a full outer join on year."""
    c = Fixtures(spark, sf).cohort
    t = c.groupBy("year").agg(F.sum("n_nom_all").alias("tot_cohort_nom"),
                              F.sum("n_win").alias("tot_cohort_awards"))
    return c.join(t, "year", "full")


@query("e4_cohort_share", oracle="""
SELECT work_id, year, round(n_nom_all / sum(n_nom_all) OVER (PARTITION BY year), 6) AS nom_share FROM cohort
""")
def e4_cohort_share(spark, sf):
    """Each work's share of its cohort's nominations."""
    c = Fixtures(spark, sf).cohort.select("work_id", "year", "n_nom_all")
    return cohort_share(c, "year", "n_nom_all", "nom_share") \
        .select("work_id", "year", F.round("nom_share", 6).alias("nom_share"))
