"""Projection, filter, join, aggregate, window, sort, set and reshape rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wreath.functions.aggregates import (
    concat_distinct_by,
    first_nonnull_by,
    kurtosis_unbiased,
    last_nonnull_by,
    ordered_list,
)
from wreath.operators import cohort as C
from wreath.operators import relational as R
from wreath.operators import stats as ST
from wreath.plans import stages as S
from wreath.plans.fixtures import Fixtures
from wreath.plans.registry import query

ISO = "'%Y-%m-%dT%H:%M:%SZ'"

# Headings derived row by row from documents (B14 / I14 inputs).
# The synopsis heading prefixes of the reference, in its order.
SYNOPSIS_PREFIXES = ("plot", "synopsis", "premise", "summary", "overview", "setting",
                     "back story", "backstory")
HEADINGS = ("Plot", "Reception", "Synopsis and themes", "Backstory", "History",
            "Setting", "Overview of reviews", "Awards", "Premise", "Back Story")
_HEADING_SQL = "CASE doc_id % 10 " + " ".join(
    f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADINGS)) + " END"


# ---------------------------------------------------------------- B rows
@query("b1_rename", oracle="""
SELECT title AS itemLabel, work_id AS work_qid, author_label AS authorLabel,
       author_id AS author_qid, article AS wikipedia_url, year FROM nom
""")
def b1_rename(spark, sf):
    """Columns renamed by a map."""
    return (Fixtures(spark, sf).nom.select("title", "work_id", "author_label", "author_id", "article", "year")
            .withColumnsRenamed({"title": "itemLabel", "work_id": "work_qid", "author_label": "authorLabel",
                                 "author_id": "author_qid", "article": "wikipedia_url"}))


@query("b2_project_drop", oracle="""
SELECT * EXCLUDE (openlibrary_id, isbn, article, ok, ln) FROM nom
""")
def b2_project_drop(spark, sf):
    """Identifier and key columns dropped."""
    return Fixtures(spark, sf).nom.drop("openlibrary_id", "isbn", "article", "ok", "ln")


@query("b4_assign", oracle=f"""
SELECT author_id, gender, CAST(year(try_strptime(dob, {ISO})) AS INT) AS birth_year,
       CAST(2000 - year(try_strptime(dob, {ISO})) AS INT) AS age_2000 FROM bio
""")
def b4_assign(spark, sf):
    """Computed columns: birth year and age in 2000 from an ISO date string."""
    by = F.year(F.try_to_timestamp("dob", F.lit(S.ISO_Z))).cast("int")
    return Fixtures(spark, sf).bio.withColumns({"birth_year": by, "age_2000": (2000 - by).cast("int")}) \
        .select("author_id", "gender", "birth_year", "age_2000")


@query("b5_drop_nulls", oracle="""
SELECT work_id, description FROM manual WHERE description IS NOT NULL
""")
def b5_drop_nulls(spark, sf):
    """Rows with a null description dropped."""
    return Fixtures(spark, sf).manual.dropna(subset=["description"])


@query("b6_half_open_range", oracle="""
SELECT doc_id, year, topic FROM topic_month WHERE year >= 1996 AND year < 1999
""")
def b6_half_open_range(spark, sf):
    """Half-open year range filter lo <= year < hi."""
    t = Fixtures(spark, sf).topic_month
    return t.filter((F.col("year") >= 1996) & (F.col("year") < 1999)).select("doc_id", "year", "topic")


@query("b6_date_range_pushdown", oracle="""
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
""")
def b6_date_range_pushdown(spark, sf):
    """A year filter written as a timestamp range so parquet can prune."""
    o = Fixtures(spark, sf).orders
    return o.filter((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
                    & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))) \
        .select("o_orderkey", "o_orderdate")


@query("b7_equality_filter", oracle="""
SELECT doc_id, month, topic FROM topic_month WHERE year = 1997
""")
def b7_equality_filter(spark, sf):
    """Single-year filter."""
    return Fixtures(spark, sf).topic_month.filter(F.col("year") == 1997).select("doc_id", "month", "topic")


@query("b8_not_null_not_equal", oracle="""
SELECT work_id, pos FROM tier1 WHERE description IS NOT NULL AND work_id <> 5
""")
def b8_not_null_not_equal(spark, sf):
    """Description present and one id excluded."""
    t = Fixtures(spark, sf).tier1
    return t.filter(F.col("description").isNotNull() & (F.col("work_id") != 5)).select("work_id", "pos")


@query("b9_column_compare", oracle="""
SELECT ok, ln, work_id, year FROM nom
WHERE year < CAST(substr(pub_date, 1, 4) AS INT) + 35
""")
def b9_column_compare(spark, sf):
    """Filter comparing two columns of the same row."""
    n = Fixtures(spark, sf).nom
    return n.filter(F.col("year") < F.substring("pub_date", 1, 4).cast("int") + 35) \
        .select("ok", "ln", "work_id", "year")


@query("b10_membership", oracle="""
SELECT ok, ln, award FROM nom WHERE award IN ('A', 'R') AND author_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 2, 3))
""")
def b10_membership(spark, sf):
    """IN-list filter plus a semi join against a filtered key table."""
    fx = Fixtures(spark, sf)
    chosen = fx.supplier.filter(F.col("s_nationkey").isin(1, 2, 3)).select(F.col("s_suppkey").alias("author_id"))
    return (fx.nom.filter(F.col("award").isin("A", "R"))
            .join(chosen, "author_id", "left_semi").select("ok", "ln", "award"))


@query("b11_fill_null_constants", oracle="""
SELECT work_id, coalesce(age, 0) AS age, gender FROM cohort
""")
def b11_fill_null_constants(spark, sf):
    """Missing numbers filled with a constant."""
    return Fixtures(spark, sf).cohort.select("work_id", "age", "gender").fillna({"age": 0.0})


@query("b12_cast", oracle="""
SELECT list_row, CAST(rank AS INT) AS rank_int, CAST(year AS DOUBLE) AS year_f FROM ranks
""")
def b12_cast(spark, sf):
    """Integer and double casts."""
    r = Fixtures(spark, sf).ranks
    return r.select("list_row", F.col("rank").cast("int").alias("rank_int"),
                    F.col("year").cast("double").alias("year_f"))


@query("b13_derived_boolean", oracle="""
SELECT work_id, n_win > 0 AS won FROM cohort
""")
def b13_derived_boolean(spark, sf):
    """won = n_win > 0."""
    return Fixtures(spark, sf).cohort.select("work_id", (F.col("n_win") > 0).alias("won"))


@query("b14_any_prefix", oracle=f"""
SELECT doc_id, heading FROM (SELECT doc_id, {_HEADING_SQL} AS heading FROM documents)
WHERE regexp_matches(lower(heading), '^(plot|synopsis|premise|summary|overview|setting|back story|backstory)')
""")
def b14_any_prefix(spark, sf):
    """Case-folded heading starts with one of the synopsis words."""
    from wreath.functions.text import any_prefix
    d = Fixtures(spark, sf).sql(f"SELECT doc_id, {_HEADING_SQL} AS heading FROM documents")
    return d.filter(any_prefix(F.col("heading"), SYNOPSIS_PREFIXES))


@query("b15_if_coalesce", oracle="""
SELECT doc_id, CASE WHEN lang = 'en' THEN coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, lang)
                    ELSE lang END AS picked FROM documents
""")
def b15_if_coalesce(spark, sf):
    """IF(language = en, COALESCE(a, b), b)."""
    d = Fixtures(spark, sf).documents
    work = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    return d.select("doc_id", F.when(F.col("lang") == "en", F.coalesce(work, F.col("lang")))
                    .otherwise(F.col("lang")).alias("picked"))


@query("b17_property_alternatives", oracle="""
SELECT subject, object FROM triples WHERE property IN ('won', 'nominated')
""")
def b17_property_alternatives(spark, sf):
    """Facts whose property is one of two alternatives."""
    t = Fixtures(spark, sf).triples
    return t.filter(F.col("property").isin("won", "nominated")).select("subject", "object")


# ---------------------------------------------------------------- C rows
OL_WORKS = "SELECT concat('/works/OL', CAST(doc_id AS STRING), 'W') AS key, text AS description FROM documents"


@query("c2_join_computed_key", oracle=f"""
SELECT DISTINCT i.work_id, w.description
FROM (SELECT work_id, openlibrary_id FROM nom WHERE openlibrary_id IS NOT NULL) i
JOIN ({OL_WORKS}) w ON '/works/' || i.openlibrary_id = w.key
WHERE w.description IS NOT NULL AND i.openlibrary_id <> 'OL10W'
""")
def c2_join_computed_key(spark, sf):
    """Join on a computed key ('/works/' || id), non-null, one id excluded, DISTINCT."""
    fx = Fixtures(spark, sf)
    ids = fx.nom.select("work_id", "openlibrary_id").filter(F.col("openlibrary_id").isNotNull())
    works = fx.sql(OL_WORKS)
    return (ids.join(works, F.concat(F.lit("/works/"), ids["openlibrary_id"]) == works["key"])
            .filter(works["description"].isNotNull() & (ids["openlibrary_id"] != "OL10W"))
            .select("work_id", "description").distinct())


@query("c5_left_anti_chain", oracle="""
SELECT DISTINCT work_id FROM tier3
WHERE work_id NOT IN (SELECT work_id FROM tier1 WHERE description IS NOT NULL)
  AND work_id NOT IN (SELECT work_id FROM tier2 WHERE description IS NOT NULL)
""")
def c5_left_anti_chain(spark, sf):
    """Works of the third tier not solved by the first two (anti join chain)."""
    fx = Fixtures(spark, sf)
    solved1 = fx.tier1.filter(F.col("description").isNotNull()).select("work_id")
    solved2 = fx.tier2.filter(F.col("description").isNotNull()).select("work_id")
    return (fx.tier3.select("work_id").join(solved1, "work_id", "left_anti")
            .join(solved2, "work_id", "left_anti").distinct())


@query("c7_shifted_equality_join", oracle="""
SELECT a.unique_id AS unique_id_l, b.unique_id AS unique_id_r, b.year AS year_r
FROM catalog_a a JOIN catalog_b b ON a.year = b.year - 1
""")
def c7_shifted_equality_join(spark, sf):
    """Pairs across two catalogues blocked on list year = award year - 1."""
    fx = Fixtures(spark, sf)
    p = R.blocked_pairs(fx.catalog_a, fx.catalog_b, F.col("year"), F.col("year") - 1)
    return p.select("unique_id_l", "unique_id_r", "year_r")


@query("g3_two_set_link_input", oracle="""
SELECT b.year AS year_r, CAST(count(*) AS BIGINT) AS n_pairs
FROM catalog_a a JOIN catalog_b b ON a.year = b.year - 1 GROUP BY b.year
""")
def g3_two_set_link_input(spark, sf):
    """Number of candidate pairs per block across the two sets only, from the sides' counts."""
    fx = Fixtures(spark, sf)
    a = fx.catalog_a.groupBy((F.col("year") + 1).alias("year_r")).agg(F.count(F.lit(1)).alias("n_a"))
    b = fx.catalog_b.groupBy(F.col("year").alias("year_r")).agg(F.count(F.lit(1)).alias("n_b"))
    return a.join(b, "year_r").select("year_r", (F.col("n_a") * F.col("n_b")).alias("n_pairs"))


@query("c9_fill_join", oracle="""
WITH primary_ AS (
  SELECT work_id, description FROM tier1 WHERE description IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY pos) = 1),
fallback AS (SELECT work_id, description FROM manual WHERE description IS NOT NULL)
SELECT coalesce(p.work_id, f.work_id) AS work_id, coalesce(p.description, f.description) AS description
FROM primary_ p FULL JOIN fallback f ON p.work_id = f.work_id
""")
def c9_fill_join(spark, sf):
    """Combine-first: primary descriptions win, manual ones fill and add works."""
    fx = Fixtures(spark, sf)
    primary = R.dedup_first(fx.tier1.filter(F.col("description").isNotNull()), "work_id", ["pos"]) \
        .select("work_id", "description")
    return R.fill_join(primary, fx.manual.dropna(subset=["description"]), "work_id")


@query("c11_index_join_melt", oracle="""
WITH long AS (
  SELECT work_id, 'score' AS metric, score AS value FROM cohort
  UNION ALL SELECT work_id, 'age', age FROM cohort)
SELECT l.work_id, l.metric, l.value, c.n_win > 0 AS won, c.year
FROM long l LEFT JOIN cohort c USING (work_id)
""")
def c11_index_join_melt(spark, sf):
    """Melted (long) rows joined back to their wide row by key."""
    c = Fixtures(spark, sf).cohort
    long = c.unpivot("work_id", ["score", "age"], "metric", "value")
    return long.join(c.select("work_id", (F.col("n_win") > 0).alias("won"), "year"), "work_id", "left")


# ---------------------------------------------------------------- D rows
@query("d5_first_last_nonnull", oracle="""
SELECT work_id,
       arg_min(isbn, ok * 10 + ln) FILTER (WHERE isbn IS NOT NULL) AS first_isbn,
       arg_max(openlibrary_id, ok * 10 + ln) FILTER (WHERE openlibrary_id IS NOT NULL) AS last_ol
FROM nom GROUP BY work_id
""")
def d5_first_last_nonnull(spark, sf):
    """First non-null ISBN and last non-null OpenLibrary id per work in record order."""
    return Fixtures(spark, sf).nom.groupBy("work_id").agg(
        first_nonnull_by("isbn", "ok", "ln").alias("first_isbn"),
        last_nonnull_by("openlibrary_id", "ok", "ln").alias("last_ol"))


@query("d6_max_count_median", oracle="""
SELECT title_id, year, max(rank) AS "max", CAST(count(rank) AS BIGINT) AS "count", median(rank) AS "median"
FROM ranks GROUP BY title_id, year
""")
def d6_max_count_median(spark, sf):
    """Max, count and median rank per (title, year)."""
    return ST.counted_median(Fixtures(spark, sf).ranks, ["title_id", "year"], "rank")


@query("d7_mean_sum_list", oracle="""
SELECT work_id, round(avg(l_quantity), 6) AS mean_quantity, round(sum(l_extendedprice), 2) AS sum_price,
       list(CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_returnflag END ORDER BY l_orderkey, l_linenumber, l_suppkey) AS flags
FROM (SELECT l_partkey AS work_id, * FROM lineitem) GROUP BY work_id
""")
def d7_mean_sum_list(spark, sf):
    """Collapse the rows of each work (co-author style): mean, sum, and the
    list of a column in an explicit order with nulls kept. Groups are works,
    whose row count is the work's own record count."""
    l = Fixtures(spark, sf).lineitem
    flag = F.when(F.col("l_linenumber") % 5 == 0, F.lit(None)).otherwise(F.col("l_returnflag"))
    return l.groupBy(F.col("l_partkey").alias("work_id")).agg(
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_price"),
        ordered_list(flag, "l_orderkey", "l_linenumber", "l_suppkey").alias("flags"))


@query("d8_distinct_concat", oracle="""
WITH f AS (SELECT work_id, author_label, min([ok, CAST(ln AS BIGINT), author_id]) AS p FROM nom GROUP BY ALL)
SELECT work_id, string_agg(author_label, ' ' ORDER BY p) AS authors FROM f GROUP BY work_id
""")
def d8_distinct_concat(spark, sf):
    """Distinct author names per work joined by a space in first-seen order."""
    return concat_distinct_by(Fixtures(spark, sf).nom, "work_id", "author_label", ["ok", "ln", "author_id"],
                              out="authors")


@query("d9_first_in_group", oracle="""
SELECT work_id, title, arg_min(author_label, author_id) AS first_author FROM nom GROUP BY work_id, title
""")
def d9_first_in_group(spark, sf):
    """First author label per (work, title) by author id."""
    return Fixtures(spark, sf).nom.groupBy("work_id", "title").agg(
        F.min_by("author_label", "author_id").alias("first_author"))


@query("d10_cohort_totals", oracle="""
SELECT year, CAST(sum(n_nom_all) AS BIGINT) AS tot_cohort_nom, CAST(sum(n_win) AS BIGINT) AS tot_cohort_awards
FROM cohort GROUP BY year
""")
def d10_cohort_totals(spark, sf):
    """Sums of nominations and wins per cohort year."""
    return Fixtures(spark, sf).cohort.groupBy("year").agg(
        F.sum("n_nom_all").cast("bigint").alias("tot_cohort_nom"),
        F.sum("n_win").cast("bigint").alias("tot_cohort_awards"))


@query("d11_count_distinct_union", oracle="""
SELECT CAST(count(DISTINCT work_id) AS BIGINT) AS n_identified FROM (
  SELECT work_id FROM nom WHERE openlibrary_id IS NOT NULL
  UNION ALL SELECT work_id FROM nom WHERE isbn IS NOT NULL
  UNION ALL SELECT work_id FROM nom WHERE article IS NOT NULL)
""")
def d11_count_distinct_union(spark, sf):
    """Distinct works present in any of three identifier tables."""
    n = Fixtures(spark, sf).nom
    u = (n.filter(F.col("openlibrary_id").isNotNull()).select("work_id")
         .unionByName(n.filter(F.col("isbn").isNotNull()).select("work_id"))
         .unionByName(n.filter(F.col("article").isNotNull()).select("work_id")))
    return u.agg(F.count_distinct("work_id").cast("bigint").alias("n_identified"))


@query("j25_coverage_report", oracle="""
WITH covered AS (
  SELECT work_id FROM nom WHERE openlibrary_id IS NOT NULL
  UNION SELECT work_id FROM nom WHERE isbn IS NOT NULL
  UNION SELECT work_id FROM nom WHERE article IS NOT NULL),
allw AS (SELECT DISTINCT work_id FROM nom)
SELECT CAST(count(*) AS BIGINT) AS n_works, CAST(count(c.work_id) AS BIGINT) AS n_covered,
       CAST(count(*) - count(c.work_id) AS BIGINT) AS n_missing
FROM allw a LEFT JOIN covered c USING (work_id)
""")
def j25_coverage_report(spark, sf):
    """Works, works with any identifier, and works without."""
    n = Fixtures(spark, sf).nom
    srcs = [S.identifier_table(n, c).select("work_id") for c in ("openlibrary_id", "isbn", "article")]
    return ST.coverage_report(n, "work_id", srcs)


@query("d12_row_distinct", oracle="""
SELECT DISTINCT work_id, description FROM tier1
""")
def d12_row_distinct(spark, sf):
    """Full-row DISTINCT."""
    return Fixtures(spark, sf).tier1.select("work_id", "description").distinct()


TOPIC_FREQ = """
SELECT year, topic, month, CAST(count(*) AS BIGINT) AS frequency FROM topic_month GROUP BY ALL"""


@query("d25_monthly_frequency", oracle=TOPIC_FREQ)
def d25_monthly_frequency(spark, sf):
    """Documents per (year, topic, month)."""
    from wreath.operators.topics import topics_over_time
    return topics_over_time(Fixtures(spark, sf).topic_month, "year", "topic", "month")


@query("d14_every_any", oracle=f"""
WITH f AS ({TOPIC_FREQ})
SELECT year, topic, max(frequency) >= 10 AS any_frequent, bool_and(frequency < 10) AS all_rare
FROM f GROUP BY year, topic
""")
def d14_every_any(spark, sf):
    """Per topic: any month with >= 10 documents, and all months below 10."""
    from wreath.operators.topics import topics_over_time
    f = topics_over_time(Fixtures(spark, sf).topic_month, "year", "topic", "month")
    return f.groupBy("year", "topic").agg((F.max("frequency") >= 10).alias("any_frequent"),
                                          F.bool_and(F.col("frequency") < 10).alias("all_rare"))


@query("d15_conditional_mean", oracle="""
SELECT n_win > 0 AS won, round(avg(score), 6) AS mean_score,
       round(avg(CASE WHEN gender = 'female' THEN score END), 6) AS mean_score_female
FROM cohort GROUP BY ALL
""")
def d15_conditional_mean(spark, sf):
    """Mean score by won flag, and a conditional mean inside the group."""
    c = Fixtures(spark, sf).cohort
    return c.groupBy((F.col("n_win") > 0).alias("won")).agg(
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.avg(F.when(F.col("gender") == "female", F.col("score"))), 6).alias("mean_score_female"))


@query("d16_group_rate", oracle="""
SELECT gender, year, CAST(sum(n_win) AS BIGINT) AS n_win, CAST(sum(n_nom_all) AS BIGINT) AS n_nom_all,
       round(sum(n_win) / sum(n_nom_all), 6) AS rate
FROM cohort GROUP BY GROUPING SETS ((gender), (gender, year))
""")
def d16_group_rate(spark, sf):
    """Win rate sum(win)/sum(nominations) per gender and per gender x year."""
    c = Fixtures(spark, sf).cohort
    a = ST.group_rate(c, ["gender"], "n_win", "n_nom_all").withColumn("year", F.lit(None).cast("int"))
    b = ST.group_rate(c, ["gender", "year"], "n_win", "n_nom_all")
    return a.unionByName(b).select("gender", "year", F.col("n_win").cast("bigint").alias("n_win"),
                                   F.col("n_nom_all").cast("bigint").alias("n_nom_all"),
                                   F.round("rate", 6).alias("rate"))


@query("d17_mean_interval", oracle="""
SELECT year, round(avg(age), 6) AS mean, CAST(count(age) AS BIGINT) AS n,
       round(avg(age) - 1.96 * stddev_samp(age) / sqrt(count(age)), 6) AS lo,
       round(avg(age) + 1.96 * stddev_samp(age) / sqrt(count(age)), 6) AS hi
FROM cohort GROUP BY year
""")
def d17_mean_interval(spark, sf):
    """Mean age per year with a normal 95% interval."""
    m = ST.mean_interval(Fixtures(spark, sf).cohort, "year", "age")
    return m.select("year", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], "n")


@query("d18_five_number", oracle="""
SELECT n_win, q[1] AS q0, q[2] AS q1, q[3] AS q2, q[4] AS q3, q[5] AS q4 FROM (
  SELECT n_win, quantile_cont(age, [0, 0.25, 0.5, 0.75, 1]) AS q FROM cohort GROUP BY n_win)
""")
def d18_five_number(spark, sf):
    """Min, quartiles and max of age per number of wins."""
    return ST.five_number(Fixtures(spark, sf).cohort, "n_win", "age")


@query("d19_histogram", oracle="""
SELECT gender, floor(age / 10) * 10 AS bin_lo, CAST(count(*) AS BIGINT) AS n
FROM cohort WHERE age IS NOT NULL GROUP BY ALL
""")
def d19_histogram(spark, sf):
    """Age histogram in 10-year bins per gender."""
    return ST.histogram(Fixtures(spark, sf).cohort, "age", 10, by=["gender"]) \
        .withColumn("bin_lo", F.col("bin_lo").cast("double"))


@query("d20_mixed_wide_agg", oracle="""
WITH j AS (SELECT c.*, v.embedding FROM (SELECT * FROM cohort) c LEFT JOIN vec v ON v.vec_id = c.work_id)
SELECT year, round(avg(age), 6) AS mean_age, CAST(sum(n_nom_all) AS BIGINT) AS n_nom_all,
       [round(CAST(x AS DOUBLE), 6) for x in arg_min(embedding, work_id) FILTER (WHERE embedding IS NOT NULL)] AS first_embedding,
       CAST(count(*) FILTER (WHERE gender = 'female') AS BIGINT) AS gender_female,
       CAST(count(*) FILTER (WHERE gender = 'male') AS BIGINT) AS gender_male
FROM j GROUP BY year
""")
def d20_mixed_wide_agg(spark, sf):
    """Per year: mean, sum, first vector by key, indicator counts."""
    fx = Fixtures(spark, sf)
    j = fx.cohort.join(fx.vec.select(F.col("vec_id").alias("work_id"), "embedding"), "work_id", "left")
    return j.groupBy("year").agg(
        F.round(F.avg("age"), 6).alias("mean_age"), F.sum("n_nom_all").cast("bigint").alias("n_nom_all"),
        F.transform(first_nonnull_by("embedding", "work_id"), lambda x: F.round(x.cast("double"), 6))
        .alias("first_embedding"),
        F.count_if(F.col("gender") == "female").cast("bigint").alias("gender_female"),
        F.count_if(F.col("gender") == "male").cast("bigint").alias("gender_male"))


@query("d21_kurtosis_unbiased", oracle=f"""
WITH f AS ({TOPIC_FREQ}),
g AS (SELECT DISTINCT year, topic FROM f),
d AS (SELECT g.year, g.topic, m.month, coalesce(f.frequency, 0) AS frequency
      FROM g CROSS JOIN range(1, 13) m(month)
      LEFT JOIN f ON f.year = g.year AND f.topic = g.topic AND f.month = m.month)
SELECT year, topic, round(kurtosis(frequency), 6) AS kurtosis FROM d GROUP BY year, topic
""")
def d21_kurtosis_unbiased(spark, sf):
    """Bias-corrected sample excess kurtosis of each topic's 12-month series."""
    from wreath.operators.topics import topics_over_time
    f = topics_over_time(Fixtures(spark, sf).topic_month, "year", "topic", "month")
    d = R.densify(f, ["year", "topic"], "month", 1, 12, "frequency")
    return d.groupBy("year", "topic").agg(F.round(kurtosis_unbiased("frequency"), 6).alias("kurtosis"))


@query("d22_share_of_total", oracle="""
WITH s AS (SELECT label, CAST(count(*) AS BIGINT) AS size FROM vec GROUP BY label)
SELECT label, size, round(size / sum(size) OVER (), 6) AS share FROM s
""")
def d22_share_of_total(spark, sf):
    """Each label's share of all vectors."""
    s = Fixtures(spark, sf).vec.groupBy("label").agg(F.count(F.lit(1)).cast("bigint").alias("size"))
    return ST.share_of_total(s, "size").withColumn("share", F.round("share", 6))


@query("d27_non_null_counts", oracle="""
SELECT CAST(count(work_id) AS BIGINT) AS work_id, CAST(count(year) AS BIGINT) AS year,
       CAST(count(n_nom_all) AS BIGINT) AS n_nom_all, CAST(count(n_win) AS BIGINT) AS n_win,
       CAST(count(score) AS BIGINT) AS score, CAST(count(age) AS BIGINT) AS age,
       CAST(count(gender) AS BIGINT) AS gender
FROM cohort
""")
def d27_non_null_counts(spark, sf):
    """Non-null count of every column."""
    return ST.non_null_counts(Fixtures(spark, sf).cohort)


@query("d28_class_weights", oracle="""
WITH c AS (SELECT says_award, count(*) AS nc FROM train_vec GROUP BY says_award)
SELECT t.vec_id, t.says_award, round((SELECT sum(nc) FROM c) / ((SELECT count(*) FROM c) * c.nc), 6) AS weight
FROM train_vec t JOIN c USING (says_award)
""")
def d28_class_weights(spark, sf):
    """Balanced class weight n / (classes * n_class) on every row."""
    t = Fixtures(spark, sf).train_vec.select("vec_id", "says_award")
    return ST.balanced_weights(t, "says_award").withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- E rows
@query("e3_first_by_priority", oracle="""
WITH u AS (
  SELECT work_id, 0 AS tier, pos, description FROM tier1 WHERE description IS NOT NULL
  UNION ALL SELECT work_id, 1, pos, description FROM tier2 WHERE description IS NOT NULL AND length(description) > 0
  UNION ALL SELECT work_id, 2, pos, description FROM tier3 WHERE description IS NOT NULL AND length(description) > 0)
SELECT work_id, tier, description FROM u
QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY tier, pos) = 1
""")
def e3_first_by_priority(spark, sf):
    """First non-empty answer per work across three tiers in priority order."""
    fx = Fixtures(spark, sf)
    return R.first_tier([fx.tier1, fx.tier2, fx.tier3], "work_id", "description", pos="pos",
                        nonempty=[False, True, True])


@query("e5_cohort_softmax", oracle="""
WITH e AS (SELECT work_id, year, exp(score - max(score) OVER (PARTITION BY year)) AS e FROM cohort)
SELECT work_id, year, round(e / sum(e) OVER (PARTITION BY year), 6) AS p_win FROM e
""")
def e5_cohort_softmax(spark, sf):
    """Softmax of scores within each cohort."""
    c = Fixtures(spark, sf).cohort.select("work_id", "year", "score")
    return C.cohort_softmax(c, "year", "score").select("work_id", "year", F.round("p_win", 6).alias("p_win"))


@query("e6_top_n_per_cohort", oracle="""
WITH t AS (SELECT *, sum(n_win) OVER (PARTITION BY year) AS tot_cohort_awards FROM cohort)
SELECT work_id, year, CAST(row_number() OVER (PARTITION BY year ORDER BY score DESC, work_id) <= tot_cohort_awards AS INT) AS pred_win
FROM t
""")
def e6_top_n_per_cohort(spark, sf):
    """Top N_win works per cohort by score flagged as predicted winners."""
    c = R.cohort_total(Fixtures(spark, sf).cohort, "year", "n_win", "tot_cohort_awards")
    return C.pick_winners(c, "year", "score", "tot_cohort_awards", "work_id").select("work_id", "year", "pred_win")


# ---------------------------------------------------------------- F rows
@query("f1_sort_nulls_last", oracle="""
SELECT ok, ln, author_id, pub_date FROM nom ORDER BY pub_date ASC NULLS LAST, ok, ln, author_id
""")
def f1_sort_nulls_last(spark, sf):
    """Records sorted by date ascending with nulls last, then key."""
    n = Fixtures(spark, sf).nom
    return n.select("ok", "ln", "author_id", "pub_date").orderBy(
        F.col("pub_date").asc_nulls_last(), "ok", "ln", "author_id")


@query("f2_multi_key_order", oracle="""
WITH per_year AS (SELECT author_id, author_label, year, count(award) AS n FROM awards GROUP BY ALL)
SELECT author_label, year, CAST(sum(n) OVER (PARTITION BY author_id ORDER BY year) AS BIGINT) AS awards_as_of_year
FROM per_year ORDER BY author_label, year
""")
def f2_multi_key_order(spark, sf):
    """Running totals ordered by label, then year."""
    c = S.cumulative_awards(Fixtures(spark, sf).awards)
    return c.select("author_label", "year", "awards_as_of_year").orderBy("author_label", "year")


@query("f3_first_match_in_list", oracle="""
SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: length(l) > 80)[1] AS first_long_line FROM documents
""")
def f3_first_match_in_list(spark, sf):
    """First line longer than 80 characters of each document."""
    d = Fixtures(spark, sf).documents
    lines = F.split(F.col("text"), "\n")
    return d.select("doc_id", F.get(F.filter(lines, lambda l: F.length(l) > 80), 0).alias("first_long_line"))


@query("f4_head_after_order", oracle="""
SELECT work_id, score FROM cohort ORDER BY score DESC, work_id LIMIT 5
""")
def f4_head_after_order(spark, sf):
    """A top-5 preview: the limit is the feature; Spark plans it as a
    TakeOrderedAndProject (per-partition top 5, then a merge)."""
    return Fixtures(spark, sf).cohort.select("work_id", "score").orderBy(F.col("score").desc(), "work_id").limit(5)


@query("f4_scalar", oracle="""
SELECT CAST(count(DISTINCT work_id) AS BIGINT) AS n_works FROM nom
""")
def f4_scalar(spark, sf):
    """A one-value result: number of distinct works."""
    return Fixtures(spark, sf).nom.agg(F.count_distinct("work_id").cast("bigint").alias("n_works"))


@query("f5_sorted_series", oracle=f"""
WITH f AS ({TOPIC_FREQ})
SELECT year, topic, list(frequency ORDER BY month) AS series FROM f GROUP BY year, topic
""")
def f5_sorted_series(spark, sf):
    """Each topic's monthly counts as a list ordered by month."""
    from wreath.operators.topics import topics_over_time
    f = topics_over_time(Fixtures(spark, sf).topic_month, "year", "topic", "month")
    return f.groupBy("year", "topic").agg(ordered_list("frequency", "month").alias("series"))


# ---------------------------------------------------------------- G rows
@query("g1_union_by_name", oracle="""
SELECT work_id, 'openlibrary' AS source FROM nom WHERE openlibrary_id IS NOT NULL
UNION ALL SELECT work_id, 'isbn' FROM nom WHERE isbn IS NOT NULL
UNION ALL SELECT work_id, 'wikipedia' FROM nom WHERE article IS NOT NULL
""")
def g1_union_by_name(spark, sf):
    """Work ids of three identifier sources stacked by name with a source label."""
    n = Fixtures(spark, sf).nom
    parts = [n.filter(F.col(c).isNotNull()).select(F.lit(s).alias("source"), "work_id")
             for c, s in (("openlibrary_id", "openlibrary"), ("isbn", "isbn"), ("article", "wikipedia"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- H rows
LINES_SQL = """
SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
UNION ALL SELECT -1 - 2 * doc_id, NULL FROM documents
UNION ALL SELECT -2 - 2 * doc_id, [] FROM documents"""


def _lines(fx):
    """Lines of every document, and for each a row with no list and an empty one."""
    d = fx.documents
    none = F.lit(None).cast("array<string>")
    return (d.select("doc_id", F.split("text", "\n").alias("lines"))
            .union(d.select(-1 - 2 * F.col("doc_id"), none))
            .union(d.select(-2 - 2 * F.col("doc_id"), F.array().cast("array<string>"))))


@query("h1_explode_outer", oracle=f"""
WITH l AS ({LINES_SQL})
SELECT doc_id, unnest(CASE WHEN lines IS NULL OR len(lines) = 0 THEN [NULL] ELSE lines END) AS line FROM l
""")
def h1_explode_outer(spark, sf):
    """Lines of each document exploded; empty and null lists give one null row."""
    return _lines(Fixtures(spark, sf)).select("doc_id", F.explode_outer("lines").alias("line"))


@query("h2_zipped_explode", oracle=f"""
WITH l AS ({LINES_SQL}),
z AS (SELECT doc_id, lines, [length(x) for x in lines] AS sizes FROM l)
SELECT doc_id, unnest(CASE WHEN lines IS NULL OR len(lines) = 0 THEN [NULL] ELSE lines END) AS lines,
       unnest(CASE WHEN sizes IS NULL OR len(sizes) = 0 THEN [NULL] ELSE sizes END) AS sizes FROM z
""")
def h2_zipped_explode(spark, sf):
    """Two equal-length lists exploded together."""
    l = _lines(Fixtures(spark, sf)).withColumn("sizes", F.transform("lines", lambda x: F.length(x)))
    return R.explode_zip(l, ["lines", "sizes"])


@query("h3_melt", oracle="""
SELECT work_id, 'score' AS metric, score AS value FROM cohort
UNION ALL SELECT work_id, 'age', age FROM cohort
""")
def h3_melt(spark, sf):
    """Wide score/age columns melted to (metric, value)."""
    return Fixtures(spark, sf).cohort.unpivot("work_id", ["score", "age"], "metric", "value")


@query("h4_dummy_columns", oracle="""
SELECT work_id, CAST(gender = 'female' AS INT) AS gender_female, CAST(gender = 'male' AS INT) AS gender_male,
       CAST(gender = 'non-binary' AS INT) AS "gender_non-binary" FROM cohort
""")
def h4_dummy_columns(spark, sf):
    """One 0/1 column per fitted gender value."""
    c = Fixtures(spark, sf).cohort.select("work_id", "gender")
    return ST.dummies(c, "gender", ["female", "male", "non-binary"])


@query("h5_densify_months", oracle=f"""
WITH f AS ({TOPIC_FREQ}),
g AS (SELECT DISTINCT year, topic FROM f)
SELECT g.year, g.topic, m.month, coalesce(f.frequency, 0) AS frequency
FROM g CROSS JOIN range(1, 13) m(month)
LEFT JOIN f ON f.year = g.year AND f.topic = g.topic AND f.month = m.month
""")
def h5_densify_months(spark, sf):
    """Every topic gets months 1..12, missing ones as 0."""
    from wreath.operators.topics import topics_over_time
    f = topics_over_time(Fixtures(spark, sf).topic_month, "year", "topic", "month")
    return R.densify(f, ["year", "topic"], "month", 1, 12, "frequency").withColumn("month", F.col("month").cast("bigint"))


@query("h6_tile_series", oracle=f"""
WITH f AS ({TOPIC_FREQ}),
s AS (SELECT year, topic, list(frequency ORDER BY month) AS series FROM f GROUP BY year, topic)
SELECT year, topic, len(flatten([series for i in range(36)])) AS n, flatten([series for i in range(36)]) AS tiled
FROM s
""")
def h6_tile_series(spark, sf):
    """Each 12-month series tiled 36 times end to end."""
    from wreath.functions.arrays import tile
    from wreath.operators.topics import topics_over_time
    f = topics_over_time(Fixtures(spark, sf).topic_month, "year", "topic", "month")
    s = f.groupBy("year", "topic").agg(ordered_list("frequency", "month").alias("series"))
    t = tile(F.col("series"), 36)
    return s.select("year", "topic", F.size(t).cast("bigint").alias("n"), t.alias("tiled"))


@query("h7_calendar_grid", oracle="""
SELECT y.year, m.month FROM (SELECT DISTINCT year FROM topic_month) y CROSS JOIN range(1, 13) m(month)
""")
def h7_calendar_grid(spark, sf):
    """Every (year, month) of the years present."""
    return R.calendar_grid(Fixtures(spark, sf).topic_month, "year").withColumn("month", F.col("month").cast("bigint"))
