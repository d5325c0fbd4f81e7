"""User-facing extension surfaces (K rows) and column arithmetic (I22)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wreath.functions import vectors as V
from wreath.operators import models as M
from wreath.operators import relational as R
from wreath.operators import topics as TP
from wreath.operators import vectors as VO
from wreath.plans.fixtures import Fixtures
from wreath.plans.queries_vectors import DIRECTION, _direction
from wreath.plans.registry import query


@query("i22_column_arithmetic", oracle="""
SELECT work_id, n_nom_all + n_win AS total, n_nom_all - n_win AS losses,
       round(CASE WHEN n_nom_all = 0 THEN NULL ELSE n_win / n_nom_all END, 6) AS win_rate,
       round(n_win / sum(n_win) OVER (PARTITION BY year), 6) AS share_of_wins
FROM cohort
""")
def i22_column_arithmetic(spark, sf):
    """Add, subtract, guarded divide and share of the cohort."""
    c = R.cohort_total(Fixtures(spark, sf).cohort, "year", "n_win", "__t")
    return c.select("work_id", (F.col("n_nom_all") + F.col("n_win")).alias("total"),
                    (F.col("n_nom_all") - F.col("n_win")).alias("losses"),
                    F.round(F.try_divide(F.col("n_win").cast("double"), F.col("n_nom_all")), 6).alias("win_rate"),
                    F.round(F.try_divide(F.col("n_win").cast("double"), F.col("__t")), 6).alias("share_of_wins"))


def _long_turn():
    def clf(texts):
        return ["LONG" if len(t) > 200 else "SHORT" for t in texts]
    return clf


@query("k1_arrow_scalar_udf", oracle="""
SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN 'LONG' ELSE 'SHORT' END AS sentiment FROM conversations
""")
def k1_arrow_scalar_udf(spark, sf):
    """string -> string through an Arrow-batched scalar UDF with an
    injected classifier (built once per Python worker)."""
    c = Fixtures(spark, sf).conversations
    return M.sentiment(c, "text", classifier_factory=_long_turn).select("conv_id", "turn", "sentiment")


@F.arrow_udf(T.LongType())
def _mode_smallest(value: pa.Array, count: pa.Array) -> int:
    """Most frequent value (smallest on a tie) from (value, count) pairs."""
    if not len(value):
        return None
    v, n = value.to_numpy(zero_copy_only=False), count.to_numpy(zero_copy_only=False)
    return int(v[n == n.max()].min())


@query("k2_grouped_agg_udf", oracle="""
WITH yc AS (SELECT work_id, year, count(*) AS c FROM nom GROUP BY ALL)
SELECT work_id, CAST(year AS BIGINT) AS modal_year FROM yc
QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY c DESC, year ASC) = 1
""")
def k2_grouped_agg_udf(spark, sf):
    """A grouped-aggregate UDF (the lambda-aggregate surface), on Arrow arrays: making
    pandas series for each of millions of groups cost more than the rest. Rows
    are first counted per (work, year) with a partial aggregate, so the
    Python step sees one row per distinct year of a work, never the work's
    raw rows; the built-in ``mode_of`` (D3) is the fast path."""
    n = Fixtures(spark, sf).nom
    yc = n.filter(F.col("year").isNotNull()).groupBy("work_id", "year").agg(F.count(F.lit(1)).alias("c"))
    return yc.groupBy("work_id").agg(_mode_smallest(F.col("year").cast("long"), F.col("c")).alias("modal_year"))


@query("k3_per_group_function", oracle="""
WITH f AS (SELECT year, topic, month, count(*) AS frequency FROM topic_month GROUP BY ALL),
g AS (SELECT DISTINCT year, topic FROM f),
d AS (SELECT g.year, g.topic, m.month, coalesce(f.frequency, 0) AS frequency
      FROM g CROSS JOIN range(1, 13) m(month)
      LEFT JOIN f ON f.year = g.year AND f.topic = g.topic AND f.month = m.month)
SELECT year, topic, CAST(arg_max(month, frequency * 100 - month) AS INT) AS peak_month,
       round(max(frequency) / avg(frequency), 6) AS peak_ratio
FROM d GROUP BY year, topic
""")
def k3_per_group_function(spark, sf):
    """``applyInPandas`` on bounded groups: each group is one topic's
    12-month series (already aggregated), never a raw cohort."""
    f = TP.monthly_series(TP.topics_over_time(Fixtures(spark, sf).topic_month, "year", "topic", "month"),
                          ["year", "topic"])

    def peak(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        fr = pdf["frequency"].to_numpy(dtype=float)
        i = int(np.argmax(fr))  # first (earliest) month on ties
        return pd.DataFrame({"year": [pdf["year"].iloc[0]], "topic": [pdf["topic"].iloc[0]],
                             "peak_month": [int(pdf["month"].iloc[i])],
                             "peak_ratio": [round(fr.max() / fr.mean(), 6)]})

    return f.groupBy("year", "topic").applyInPandas(
        peak, "year int, topic string, peak_month int, peak_ratio double")


def _add_won(df):
    return df.withColumn("won", (F.col("n_win") > 0).cast("int"))


def _add_share(df):
    return R.cohort_share(df, "year", "n_nom_all", "nom_share")


def _round(df):
    return df.select("work_id", "year", "won", F.round("nom_share", 6).alias("nom_share"))


@query("k4_transform_chain", oracle="""
SELECT work_id, year, CAST(n_win > 0 AS INT) AS won,
       round(n_nom_all / sum(n_nom_all) OVER (PARTITION BY year), 6) AS nom_share FROM cohort
""")
def k4_transform_chain(spark, sf):
    """Table functions chained with ``DataFrame.transform`` (the ``pipe`` surface)."""
    return Fixtures(spark, sf).cohort.transform(_add_won).transform(_add_share).transform(_round)


@query("k5_ml_transformer", oracle="WITH " + DIRECTION + """
SELECT vec_id, [round(e[i] - dp * w[i], 6) for i in range(1, len(e) + 1)] AS debiased FROM pv
""")
def k5_ml_transformer(spark, sf):
    """The projection as a Spark ML ``Transformer`` inside a ``Pipeline``."""
    from pyspark.ml import Pipeline
    fx = Fixtures(spark, sf)
    proj = VO.DirectionRemover(inputCol="embedding", outputCol="debiased", normal=_direction(fx))
    model = Pipeline(stages=[proj]).fit(fx.vec)
    out = model.transform(fx.vec.select("vec_id", "embedding"))
    return out.select("vec_id", V.round_vec("debiased").alias("debiased"))


def peak_over_mean(ratio: float):
    """A user filter: keep topics whose busiest month has ``ratio`` times
    the mean monthly count."""
    def f(freq, keys):
        s = TP.monthly_series(freq, keys)
        return (s.groupBy(*keys).agg((F.max("frequency") / F.avg("frequency")).alias("__r"))
                .filter(F.col("__r") >= ratio).select(*keys))
    return f


@query("k6_pluggable_filter", oracle="""
WITH f AS (SELECT year, topic, month, count(*) AS frequency FROM topic_month GROUP BY ALL),
g AS (SELECT DISTINCT year, topic FROM f),
d AS (SELECT g.year, g.topic, m.month, coalesce(f.frequency, 0) AS frequency
      FROM g CROSS JOIN range(1, 13) m(month)
      LEFT JOIN f ON f.year = g.year AND f.topic = g.topic AND f.month = m.month)
SELECT year, topic FROM f GROUP BY year, topic HAVING max(frequency) >= 10
INTERSECT
SELECT year, topic FROM d GROUP BY year, topic HAVING max(frequency) / avg(frequency) >= 3
""")
def k6_pluggable_filter(spark, sf):
    """A user-defined filter composed with the built-in minimum-frequency rule."""
    freq = TP.topics_over_time(Fixtures(spark, sf).topic_month, "year", "topic", "month")
    return TP.hot_topics(freq, "year", "topic", TP.all_of(peak_over_mean(3.0)))


@query("k7_answer_provider_table", oracle="""
SELECT conv_id, arg_min(text, turn) AS answer FROM conversations
WHERE role = 'assistant' AND text IS NOT NULL AND length(text) > 0 GROUP BY conv_id
""")
def k7_answer_provider_table(spark, sf):
    """A provider is a table of (key, position, answer) rows; the first
    non-empty answer per key wins (one tier of the fallback ladder)."""
    c = Fixtures(spark, sf).conversations.filter(F.col("role") == "assistant")
    out = R.first_tier([c.select("conv_id", "turn", F.col("text").alias("answer"))], "conv_id", "answer",
                       pos="turn", nonempty=[True])
    return out.select("conv_id", "answer")
