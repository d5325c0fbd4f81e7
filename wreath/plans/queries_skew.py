"""Hot-key variants: the same operators on data derived from the given
tables so that one key holds a third of all rows. They check that the
skew-safe plans (two-phase top-1/top-N, aggregate-and-join totals, bucketed
draws) return exactly what a plain SQL formulation returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from wreath.operators import cohort as C
from wreath.operators import relational as R
from wreath.operators import stats as ST
from wreath.plans import stages as S
from wreath.plans.fixtures import Fixtures
from wreath.plans.registry import query

HOT_NOM = """(SELECT * REPLACE (CASE WHEN author_id % 3 = 0 THEN 0 ELSE work_id END AS work_id) FROM nom)"""
HOT_RECORD = """(SELECT * REPLACE (CASE WHEN author_id % 3 = 0 THEN 0 ELSE work_id END AS work_id,
                              CASE WHEN author_id % 3 = 0 THEN 0 ELSE author_id END AS author_id,
                              CASE WHEN author_id % 3 = 0 THEN 'A' ELSE award END AS award) FROM nom)"""
HOT_COHORT = """(SELECT * REPLACE (CASE WHEN work_id % 3 = 0 THEN 1995 ELSE year END AS year) FROM cohort)"""


def _hot_nom(fx):
    return fx.nom.withColumn("work_id", F.when(F.col("author_id") % 3 == 0, F.lit(0).cast("long"))
                             .otherwise(F.col("work_id")))


def _hot_record(fx):
    hot = F.col("author_id") % 3 == 0
    return fx.nom.withColumns({
        "work_id": F.when(hot, F.lit(0).cast("long")).otherwise(F.col("work_id")),
        "author_id": F.when(hot, F.lit(0).cast("long")).otherwise(F.col("author_id")),
        "award": F.when(hot, F.lit("A")).otherwise(F.col("award"))})


def _hot_cohort(fx):
    return fx.cohort.withColumn("year", F.when(F.col("work_id") % 3 == 0, F.lit(1995))
                                .otherwise(F.col("year")))


@query("d13_dedup_first_hot_key", oracle=f"""
SELECT * EXCLUDE (openlibrary_id, isbn, article) FROM {HOT_RECORD}
QUALIFY row_number() OVER (PARTITION BY work_id, author_id, award
  ORDER BY pub_date ASC NULLS LAST, CASE WHEN status = 'winner' THEN 0 ELSE 1 END, year, ok, ln) = 1
""")
def d13_dedup_first_hot_key(spark, sf):
    """One (work, author, award) key receives a third of all records."""
    return S.dedup_award_records(_hot_record(Fixtures(spark, sf)))


@query("d3_mode_hot_key", oracle=f"""
WITH yc AS (SELECT work_id, year, count(*) AS c FROM {HOT_NOM} GROUP BY ALL)
SELECT work_id, year AS modal_year FROM yc
QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY c DESC, year ASC) = 1
""")
def d3_mode_hot_key(spark, sf):
    """Modal year per work when one work holds a third of the records."""
    from wreath.functions.aggregates import mode_of
    return _hot_nom(Fixtures(spark, sf)).groupBy("work_id").agg(mode_of("year").alias("modal_year"))


@query("e6_top_n_hot_cohort", oracle=f"""
WITH t AS (SELECT *, sum(n_win) OVER (PARTITION BY year) AS tot FROM {HOT_COHORT})
SELECT work_id, year, CAST(row_number() OVER (PARTITION BY year ORDER BY score DESC, work_id) <= tot AS INT) AS pred_win
FROM t
""")
def e6_top_n_hot_cohort(spark, sf):
    """Cohort 1995 holds a third of all works."""
    c = R.cohort_total(_hot_cohort(Fixtures(spark, sf)), "year", "n_win", "tot")
    return C.pick_winners(c, "year", "score", "tot", "work_id").select("work_id", "year", "pred_win")


@query("e5_softmax_hot_cohort", oracle=f"""
WITH e AS (SELECT work_id, year, exp(score - max(score) OVER (PARTITION BY year)) AS e FROM {HOT_COHORT})
SELECT work_id, year, round(e / sum(e) OVER (PARTITION BY year), 6) AS p_win FROM e
""")
def e5_softmax_hot_cohort(spark, sf):
    """Cohort softmax when one cohort holds a third of the works."""
    c = _hot_cohort(Fixtures(spark, sf)).select("work_id", "year", "score")
    return C.cohort_softmax(c, "year", "score").select("work_id", "year", F.round("p_win", 6).alias("p_win"))


@query("j16_naive_winners_hot_cohort", oracle=f"""
SELECT year, CAST(sum(n_win) AS BIGINT) AS drawn_wins FROM {HOT_COHORT} GROUP BY year
""")
def j16_naive_winners_hot_cohort(spark, sf):
    """The hot cohort is split over several buckets (small bucket size), and
    still receives exactly its number of wins."""
    c = R.cohort_total(_hot_cohort(Fixtures(spark, sf)), "year", "n_win", "tot_cohort_awards")
    d = C.naive_winners(c, "work_id", seed=5, buckets=40)
    return d.groupBy("year").agg(F.sum("naive_wins").cast("bigint").alias("drawn_wins"))


@query("c6_asof_join_hot_author", oracle="""
WITH r AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE l_suppkey END AS author_id, l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem),
o AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE o_custkey END AS author_id, o_orderkey, o_orderdate FROM orders),
p AS (SELECT author_id, l_shipdate, max(l_extendedprice) AS price FROM r GROUP BY ALL)
SELECT o.o_orderkey, o.author_id, p.price FROM o ASOF LEFT JOIN p ON o.author_id = p.author_id AND o.o_orderdate > p.l_shipdate
""")
def c6_asof_join_hot_author(spark, sf):
    """As-of lookup when one key holds half of the rows of both sides: the highest price of the last day before."""
    fx = Fixtures(spark, sf)
    half = lambda c: F.when(F.col(c) % 2 == 0, F.lit(0)).otherwise(F.col(c)).alias("author_id")
    right = fx.table("lineitem").select(half("l_suppkey"), "l_shipdate", F.col("l_extendedprice").alias("price"))
    left = fx.table("orders").select("o_orderkey", half("o_custkey"), "o_orderdate")
    return R.asof_join(left, right, "author_id", "o_orderdate", "l_shipdate", "price", method="scan").drop("o_orderdate")


@query("d18_five_number_hot_group", oracle="""
SELECT supp, q[1] AS q0, q[2] AS q1, q[3] AS q2, q[4] AS q3, q[5] AS q4 FROM (
  SELECT supp, quantile_cont(CAST(l_extendedprice AS DOUBLE), [0, 0.25, 0.5, 0.75, 1]) AS q
  FROM (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE l_suppkey END AS supp, l_extendedprice FROM lineitem) GROUP BY supp)
""")
def d18_five_number_hot_group(spark, sf):
    """Five-number summary of line prices when one supplier holds half of the lines."""
    half = F.when(F.col("l_suppkey") % 2 == 0, F.lit(0)).otherwise(F.col("l_suppkey")).alias("supp")
    return ST.five_number(Fixtures(spark, sf).table("lineitem").select(half, F.col("l_extendedprice").cast("double").alias("x")), "supp", "x")
