"""Topic rows: frequencies, filters, hot topics, per-cohort k-means, topicality."""

from __future__ import annotations

from pyspark.sql import functions as F

from wreath.operators import density as DT
from wreath.operators import topics as TP
from wreath.plans.fixtures import Fixtures
from wreath.plans.registry import query

FREQ = """
freq AS (SELECT year, topic, month, CAST(count(*) AS BIGINT) AS frequency FROM topic_month GROUP BY ALL),
grid AS (SELECT DISTINCT year, topic FROM freq),
series AS (SELECT g.year, g.topic, m.month, coalesce(f.frequency, 0) AS frequency
           FROM grid g CROSS JOIN range(1, 13) m(month)
           LEFT JOIN freq f ON f.year = g.year AND f.topic = g.topic AND f.month = m.month)"""


# The ADF test of a tiled series in SQL: moment matrices of [1, u, u*u, level, lagged differences, difference],
# swept regressor by regressor; as in the operator, a dependent regressor or an exact fit ends the sweep.
ADF_LAGS = 18


def _moments_sql(source: str, lags: str) -> str:
    cols = (f"[list_transform(range(1, n + 1), lambda i: CAST(1 AS DOUBLE)), list_transform(range(1, n + 1), lambda i: -1 + 2.0 * (i - 1) / (n - 1)), "
            f"list_transform(range(1, n + 1), lambda i: (-1 + 2.0 * (i - 1) / (n - 1)) * (-1 + 2.0 * (i - 1) / (n - 1))), x[{lags} + 1 : {lags} + n]] "
            f"|| list_transform(range(1, {lags} + 1), lambda k: dx[{lags} - k + 1 : {lags} - k + n]) || [dx[{lags} + 1 : {lags} + n]]")
    return (f"SELECT year, topic, n, {lags} AS lags, list_transform(c, lambda a: list_transform(c, lambda b: list_dot_product(a, b))) AS a "
            f"FROM (SELECT year, topic, n, {lags}, {cols} AS c FROM (SELECT *, len(dx) - {lags} AS n FROM {source}))")


def _sweep_sql(name: str, source: str) -> str:
    """Recursion over (k, a): ``a`` after k regressors; rows end with a dependent one or an exact fit."""
    return f"""
{name} AS (
  SELECT year, topic, n, lags, 0 AS k, a, list_transform(range(1, len(a) + 1), lambda i: a[i][i]) AS size FROM {source}
  UNION ALL
  SELECT * FROM (
    SELECT year, topic, n, lags, k + 1 AS k,
           list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) + 1), lambda j:
             CASE WHEN i = k + 1 AND j = k + 1 THEN 1 / a[k + 1][k + 1] WHEN i = k + 1 THEN a[k + 1][j] / a[k + 1][k + 1]
                  WHEN j = k + 1 THEN -a[i][k + 1] / a[k + 1][k + 1] ELSE a[i][j] - a[i][k + 1] * a[k + 1][j] / a[k + 1][k + 1] END)) AS a, size
    FROM {name} WHERE k < len(a) - 1 AND a[k + 1][k + 1] > 1e-8 * size[k + 1])
  WHERE a[len(a)][len(a)] > 1e-8 * size[len(a)])"""


ADF = f"""
tiled AS (SELECT year, topic, list_transform(range(0, 432), lambda i: (s[i % 12 + 1] - list_avg(s)) / list_stddev_pop(s)) AS x
          FROM (SELECT year, topic, list(CAST(frequency AS DOUBLE) ORDER BY month) AS s FROM series GROUP BY year, topic) WHERE list_stddev_pop(s) > 0),
walk AS (SELECT year, topic, x, list_transform(range(1, 432), lambda i: x[i + 1] - x[i]) AS dx, {ADF_LAGS} AS most FROM tiled),
m1 AS ({_moments_sql('walk', 'most')}),{_sweep_sql('w1', 'm1')},
picked AS (SELECT year, topic, arg_min(k - 4, n * ln(a[len(a)][len(a)] / n) + 2 * k) AS best FROM w1 WHERE k >= 4 GROUP BY year, topic),
again AS (SELECT w.year, w.topic, w.x, w.dx, p.best FROM walk w JOIN picked p ON p.year = w.year AND p.topic = w.topic),
m2 AS ({_moments_sql('again', 'best')}),{_sweep_sql('w2', 'm2')},
tau AS (SELECT year, topic, a[4][len(a)] / sqrt(a[len(a)][len(a)] / (n - lags - 4) * a[4][4]) AS tau FROM w2 WHERE k = lags + 4),
stat AS (SELECT year, topic FROM tau
         WHERE tau <= 0.54 AND (tau < -17.17 OR CASE WHEN tau <= -3.21 THEN 4.0003 + 1.658 * tau + 0.048288 * tau * tau
               ELSE 3.0778 + 0.49529 * tau - 0.41477 * tau * tau - 0.059359 * tau * tau * tau END < -1.2815515655446004))"""


def _freq(fx):
    return TP.topics_over_time(fx.topic_month, "year", "topic", "month")


@query("j5_topics_over_time", oracle="WITH " + FREQ + " SELECT year, topic, CAST(month AS INT) AS month, frequency FROM series")
def j5_topics_over_time(spark, sf):
    """Monthly frequencies densified to 12 months per topic."""
    s = TP.monthly_series(_freq(Fixtures(spark, sf)), ["year", "topic"])
    return s.withColumn("month", F.col("month").cast("int"))


@query("j6_min_frequency", oracle="WITH " + FREQ + " SELECT year, topic FROM freq GROUP BY year, topic HAVING max(frequency) >= 10")
def j6_min_frequency(spark, sf):
    """Topics with at least one month of 10 or more documents."""
    return TP.min_frequency(10)(_freq(Fixtures(spark, sf)), ["year", "topic"])


@query("j7_high_kurtosis", oracle="WITH " + FREQ + " SELECT year, topic FROM series GROUP BY year, topic HAVING kurtosis(frequency) > 2")
def j7_high_kurtosis(spark, sf):
    """Topics whose monthly series has kurtosis above 2."""
    return TP.high_kurtosis(2.0)(_freq(Fixtures(spark, sf)), ["year", "topic"])


@query("j15_hot_topics", oracle="WITH " + FREQ + """
SELECT year, topic FROM freq GROUP BY year, topic HAVING max(frequency) >= 10
INTERSECT
SELECT year, topic FROM series GROUP BY year, topic HAVING kurtosis(frequency) > 2
""")
def j15_hot_topics(spark, sf):
    """Topics passing the minimum-frequency and kurtosis filters."""
    f = TP.all_of(TP.high_kurtosis(2.0))
    return TP.hot_topics(_freq(Fixtures(spark, sf)), "year", "topic", f)


@query("j8_stationary_filter", oracle="WITH RECURSIVE " + FREQ.strip() + "," + ADF + " SELECT year, topic FROM stat")
def j8_stationary_filter(spark, sf):
    """ADF ('ctt', AIC lags) on each tiled 12-month series, p-value from the
    published surface; rows are (year, topic) that pass at 0.1."""
    return TP.stationary(pvalue_threshold=0.1, n_periods=3)(_freq(Fixtures(spark, sf)), ["year", "topic"])


@query("j15_hot_topics_with_stationarity", oracle="WITH RECURSIVE " + FREQ.strip() + "," + ADF + """
SELECT year, topic FROM freq GROUP BY year, topic HAVING max(frequency) >= 10
INTERSECT
SELECT year, topic FROM series GROUP BY year, topic HAVING kurtosis(frequency) > 2
INTERSECT
SELECT year, topic FROM stat
""")
def j15_hot_topics_with_stationarity(spark, sf):
    """Hot topics with the ADF stationarity filter added."""
    f = TP.all_of(TP.high_kurtosis(2.0), TP.stationary(0.1, 3))
    return TP.hot_topics(_freq(Fixtures(spark, sf)), "year", "topic", f)


# Headline stream for topicality: vectors dated by id; labels 0 and 1 burst
# in one month, the other labels spread over the year.
def _stream(fx):
    return fx.sql("SELECT vec_id, embedding, label AS topic, CAST(1996 + vec_id % 2 AS INT) AS year, "
                  "CAST(CASE WHEN label IN (0, 1) THEN 1 + label * 5 ELSE 1 + floor(vec_id / 2) % 12 END AS INT) AS month "
                  "FROM vec")


J29_SQL = """
WITH RECURSIVE stream AS (SELECT vec_id, embedding, label AS topic, CAST(1996 + vec_id % 2 AS INT) AS year,
       CAST(CASE WHEN label IN (0, 1) THEN 1 + label * 5 ELSE 1 + floor(vec_id / 2) % 12 END AS INT) AS month FROM vec),
freq AS (SELECT year, topic, month, count(*) AS frequency FROM stream GROUP BY ALL),
grid AS (SELECT DISTINCT year, topic FROM freq),
series AS (SELECT g.year, g.topic, m.month, coalesce(f.frequency, 0) AS frequency
           FROM grid g CROSS JOIN range(1, 13) m(month)
           LEFT JOIN freq f ON f.year = g.year AND f.topic = g.topic AND f.month = m.month),""" + ADF + """,
hot AS (SELECT year, topic FROM freq GROUP BY year, topic HAVING max(frequency) >= 10
        INTERSECT SELECT year, topic FROM series GROUP BY year, topic HAVING kurtosis(frequency) > 2
        INTERSECT SELECT year, topic FROM stat),
u AS (SELECT s.year, s.topic, unnest(CAST(s.embedding AS DOUBLE[])) AS x, generate_subscripts(s.embedding, 1) AS i
      FROM stream s JOIN hot h ON h.year = s.year AND h.topic = s.topic),
m AS (SELECT year, topic, i, avg(x) AS m FROM u GROUP BY ALL),
cent AS (SELECT year, topic, list(m ORDER BY i) AS centroid FROM m GROUP BY year, topic),
docs AS (SELECT vec_id, embedding, CAST(1996 + vec_id % 2 AS INT) AS year FROM vec)
SELECT d.vec_id, d.year,
       round(coalesce(sum(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), c.centroid)), 0), 6) AS topicality
FROM docs d LEFT JOIN cent c ON c.year = d.year GROUP BY d.vec_id, d.year
"""


@query("j29_topicality", oracle=J29_SQL)
def j29_topicality(spark, sf):
    """Hot topics per year from a dated stream, scored against each document."""
    fx = Fixtures(spark, sf)
    docs = fx.vec.select("vec_id", "embedding", (1996 + F.col("vec_id") % 2).cast("int").alias("year"))
    t = TP.topicality(docs, "vec_id", "embedding", ["year"], _stream(fx), "embedding", "topic", "month")
    return t.select("vec_id", "year", F.round("topicality", 6).alias("topicality"))


@query("j4_fit_topics")
def j4_fit_topics(spark, sf):
    """k-means with 6 topics for every year of the stream in one job
    (rows-only: one row per vector with its topic)."""
    fx = Fixtures(spark, sf)
    assigned, cents = TP.fit_topics(_stream(fx), "vec_id", "embedding", by=["year"], k=6, seed=3)
    return assigned


@query("j4_density_topics")
def j4_density_topics(spark, sf):
    """Topics by density for every year of the stream in one job: their number comes from the data
    and scattered vectors get -1 (rows-only: one row per vector with its topic)."""
    return DT.density_topics(_stream(Fixtures(spark, sf)), "vec_id", "embedding", by=["year"])[0]


@query("j29_topicality_fitted")
def j29_topicality_fitted(spark, sf):
    """The whole stage: topics fitted per year by density, their monthly series
    filtered (frequency, kurtosis, stationarity), then works scored; the year of a work
    is the first of its award records, and years outside [1959, 2025) are left out."""
    fx = Fixtures(spark, sf)
    stream = _stream(fx)
    assigned, _ = DT.density_topics(stream, "vec_id", "embedding", by=["year"])
    topics = stream.drop("topic").join(assigned.where("topic >= 0"), ["vec_id", "year"])
    docs = TP.dated_works(fx.vec.select(F.col("vec_id").alias("work_id"), "embedding"),
                          fx.nom.select("work_id", (F.col("year") % 2 + 1996).alias("year"), "ok", "ln"), ["ok", "ln"])
    return TP.topicality(docs, "work_id", "embedding", ["year"], topics, "embedding", "topic", "month")


@query("j29_dated_works", oracle="""
WITH f AS (SELECT work_id, year FROM nom QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY ok, ln) = 1)
SELECT v.vec_id AS work_id, f.year FROM vec v JOIN f ON f.work_id = v.vec_id WHERE f.year >= 1959 AND f.year < 2025
""")
def j29_dated_works(spark, sf):
    """The work-year stage of topicality: first year per work, years in [1959, 2025)."""
    fx = Fixtures(spark, sf)
    return TP.dated_works(fx.vec.select(F.col("vec_id").alias("work_id"), "embedding"), fx.nom, ["ok", "ln"]).select("work_id", "year")
