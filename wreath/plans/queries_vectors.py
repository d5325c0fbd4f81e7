"""Vector rows: norms, kernels, centroids, bias direction, projection, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from wreath.functions import vectors as V
from wreath.operators import vectors as VO
from wreath.plans.fixtures import Fixtures
from wreath.plans.registry import query

# DuckDB: per-label centroids with element order kept.
CENTROIDS = """
u AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM vec),
m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i),
cent AS (SELECT label, list(m ORDER BY i) AS centroid FROM m GROUP BY label),
sizes AS (SELECT label, count(*) AS size FROM vec GROUP BY label)"""

DIRECTION = CENTROIDS + """,
par AS (SELECT label % 2 AS side, i, avg(x) AS m FROM u GROUP BY ALL),
dd AS (SELECT a.i, a.m - b.m AS d FROM par a JOIN par b ON a.i = b.i AND a.side = 0 AND b.side = 1),
nn AS (SELECT sqrt(sum(d * d)) AS n FROM dd),
ww AS (SELECT list(dd.d / nn.n ORDER BY dd.i) AS w FROM dd, nn),
pv AS (SELECT v.vec_id, CAST(v.embedding AS DOUBLE[]) AS e, ww.w,
              list_dot_product(CAST(v.embedding AS DOUBLE[]), ww.w) AS dp FROM vec v, ww)"""


def _centroids(fx):
    return VO.mean_vector(fx.vec, "label", "embedding").withColumnRenamed("label", "topic")


def _direction(fx):
    """Unit vector between the mean vectors of even and odd labels (a bounded,
    data-derived constant: two rows of ``dim`` numbers reach the driver)."""
    import numpy as np
    rows = {r["side"]: np.array(r["centroid"]) for r in
            VO.mean_vector(fx.vec.withColumn("side", F.col("label") % 2), "side", "embedding").collect()}
    d = rows[0] - rows[1]
    return (d / np.linalg.norm(d)).tolist()


@query("d26_mean_vector", oracle="WITH " + CENTROIDS + """
SELECT label, [round(x, 6) for x in centroid] AS centroid, CAST(size AS BIGINT) AS size
FROM cent JOIN sizes USING (label)
""")
def d26_mean_vector(spark, sf):
    """Element-wise mean vector (centroid) per label."""
    c = VO.mean_vector(Fixtures(spark, sf).vec, "label", "embedding")
    return c.withColumn("centroid", V.round_vec("centroid"))


@query("i19_norm_and_unit", oracle="""
WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum([x * x for x in CAST(embedding AS DOUBLE[])])) AS norm FROM vec)
SELECT vec_id, round(norm, 6) AS norm, [round(x / norm, 6) for x in e] AS unit FROM n
""")
def i19_norm_and_unit(spark, sf):
    """L2 norm and unit vector of every vector."""
    v = Fixtures(spark, sf).vec
    return v.select("vec_id", F.round(V.l2_norm("embedding"), 6).alias("norm"),
                    V.round_vec(V.unit("embedding")).alias("unit"))


@query("i20_dot_with_centroid", oracle="WITH " + CENTROIDS + """
SELECT v.vec_id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), c.centroid), 6) AS dot
FROM vec v JOIN cent c USING (label)
""")
def i20_dot_with_centroid(spark, sf):
    """Dot product of each vector with its label centroid."""
    fx = Fixtures(spark, sf)
    j = fx.vec.join(VO.mean_vector(fx.vec, "label", "embedding", count=None), "label")
    return j.select("vec_id", F.round(V.dot("embedding", "centroid"), 6).alias("dot"))


@query("i21_kernels", oracle="WITH " + CENTROIDS + """
, p AS (SELECT v.vec_id, CAST(v.embedding AS DOUBLE[]) AS a, c.centroid AS b FROM vec v JOIN cent c USING (label))
SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_dot_product(a, b), 6) AS linear,
       round(exp(-0.5 * list_sum([(a[i] - b[i]) * (a[i] - b[i]) for i in range(1, len(a) + 1)])), 6) AS rbf
FROM p
""")
def i21_kernels(spark, sf):
    """Cosine, linear and RBF kernels against the label centroid."""
    fx = Fixtures(spark, sf)
    j = fx.vec.join(VO.mean_vector(fx.vec, "label", "embedding", count=None), "label")
    return j.select("vec_id", F.round(V.cosine("embedding", "centroid"), 6).alias("cosine"),
                    F.round(V.linear("embedding", "centroid"), 6).alias("linear"),
                    F.round(V.rbf("embedding", "centroid", 0.5), 6).alias("rbf"))


@query("i18_abs_pow_max", oracle="""
SELECT vec_id, round(list_max([abs(x) for x in CAST(embedding AS DOUBLE[])]), 6) AS max_abs,
       round(pow(list_sum([pow(abs(x), 3) for x in CAST(embedding AS DOUBLE[])]), 1.0 / 3), 6) AS norm3
FROM vec
""")
def i18_abs_pow_max(spark, sf):
    """abs, power, root and array max over vectors."""
    e = V.as_double("embedding")
    cube = F.aggregate(F.transform(e, lambda x: F.pow(F.abs(x), 3)), F.lit(0.0), lambda a, x: a + x)
    return Fixtures(spark, sf).vec.select(
        "vec_id", F.round(F.array_max(F.transform(e, F.abs)), 6).alias("max_abs"),
        F.round(F.pow(cube, F.lit(1.0 / 3)), 6).alias("norm3"))


@query("c16_all_pairs_similarity", oracle="WITH " + CENTROIDS + """
SELECT v.vec_id, list(round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.centroid), 6) ORDER BY c.label) AS sims
FROM vec v CROSS JOIN cent c GROUP BY v.vec_id
""")
def c16_all_pairs_similarity(spark, sf):
    """Every vector with its similarities to all centroids in order: the set is one row, an array that
    AQE broadcasts when its measured size allows; nothing of it reaches the driver."""
    fx = Fixtures(spark, sf)
    cents = VO.centroid_sets(_centroids(fx).withColumn("all", F.lit(0)), ["all"])
    v = fx.vec.select("vec_id", "embedding", F.lit(0).alias("all"))
    return v.join(cents, "all").select("vec_id", F.transform("__cents", lambda c: F.round(V.cosine("embedding", c["centroid"]), 6)).alias("sims"))


@query("j3_project_out", oracle="WITH " + DIRECTION + """
SELECT vec_id, [round(e[i] - dp * w[i], 6) for i in range(1, len(e) + 1)] AS embedding FROM pv
""")
def j3_project_out(spark, sf):
    """Every vector with a data-derived unit direction projected out."""
    fx = Fixtures(spark, sf)
    out = VO.project_out(fx.vec.select("vec_id", "embedding"), "embedding", _direction(fx))
    return out.withColumn("embedding", V.round_vec("embedding"))


@query("j3_project_out_as_written", oracle="WITH " + DIRECTION + """
SELECT vec_id, [round(list_sum(e) - dp * w[i], 6) for i in range(1, len(e) + 1)] AS embedding FROM pv
""")
def j3_project_out_as_written(spark, sf):
    """The same projection in the reference's as-written arithmetic (quirk Q2)."""
    fx = Fixtures(spark, sf)
    out = VO.project_out(fx.vec.select("vec_id", "embedding"), "embedding", _direction(fx), mode="as_written")
    return out.withColumn("embedding", V.round_vec("embedding"))


def _align_sql(metric_sql: str, agg_sql: str) -> str:
    return "WITH " + CENTROIDS + f"""
, s AS (SELECT v.vec_id, c.label AS topic, sz.size / (SELECT sum(size) FROM sizes) AS weight,
               {metric_sql} AS sim
        FROM vec v CROSS JOIN cent c JOIN sizes sz ON sz.label = c.label)
SELECT vec_id, round({agg_sql}, 6) AS alignment FROM s GROUP BY vec_id
"""


COS = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.centroid)"


def _align(spark, sf, **kw):
    fx = Fixtures(spark, sf)
    a = VO.alignment(fx.vec.select("vec_id", "embedding"), _centroids(fx), "embedding", **kw)
    return a.select("vec_id", F.round("alignment", 6).alias("alignment"))


@query("j14_alignment_cosine", oracle=_align_sql(COS, "sum(sim)"))
def j14_alignment_cosine(spark, sf):
    """Sum of cosine similarities to all topic centroids (p = 1)."""
    return _align(spark, sf)


@query("j14_alignment_p2_weighted_abs", oracle=_align_sql(f"abs({COS})", "sqrt(sum(sim * sim * weight))"))
def j14_alignment_p2_weighted_abs(spark, sf):
    """Size-weighted p = 2 norm of absolute similarities."""
    return _align(spark, sf, p=2, weighted=True, mod_sim=True)


@query("j14_alignment_max", oracle=_align_sql(COS, "max(sim)"))
def j14_alignment_max(spark, sf):
    """Maximum cosine similarity to the centroids (p = inf)."""
    return _align(spark, sf, p=float("inf"))


@query("j14_alignment_linear_p3", oracle=_align_sql(
    "list_dot_product(CAST(v.embedding AS DOUBLE[]), c.centroid)",
    "CASE WHEN sum(pow(sim, 3)) < 0 THEN NULL ELSE pow(sum(pow(sim, 3)), 1.0 / 3) END"))
def j14_alignment_linear_p3(spark, sf):
    """p = 3: a negative sum under the cube root is null (NaN in numpy)."""
    return _align(spark, sf, metric="linear", p=3)


@query("j14_alignment_rbf", oracle=_align_sql(
    "exp(-5.0 * list_sum([(CAST(v.embedding AS DOUBLE[])[i] - c.centroid[i]) * (CAST(v.embedding AS DOUBLE[])[i] - c.centroid[i]) for i in range(1, len(c.centroid) + 1)]))",
    "sum(sim)"))
def j14_alignment_rbf(spark, sf):
    """Sum of RBF kernels (gamma = 5) to the centroids."""
    return _align(spark, sf, metric="rbf", gamma=5.0)


@query("j14_alignment_by_cohort", oracle="""
WITH u AS (SELECT vec_id % 3 AS cohort, label, unnest(CAST(embedding AS DOUBLE[])) AS x,
                  generate_subscripts(embedding, 1) AS i FROM vec),
m AS (SELECT cohort, label, i, avg(x) AS m FROM u GROUP BY ALL),
cent AS (SELECT cohort, label, list(m ORDER BY i) AS centroid FROM m GROUP BY cohort, label),
sizes AS (SELECT vec_id % 3 AS cohort, label, count(*) AS size FROM vec GROUP BY ALL),
s AS (SELECT v.vec_id, c.label, sz.size / sum(sz.size) OVER (PARTITION BY v.vec_id) AS weight,
             list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.centroid) AS sim
      FROM vec v JOIN cent c ON c.cohort = v.vec_id % 3
      JOIN sizes sz ON sz.cohort = c.cohort AND sz.label = c.label)
SELECT vec_id, round(sum(sim * weight), 6) AS alignment FROM s GROUP BY vec_id
""")
def j14_alignment_by_cohort(spark, sf):
    """One centroid set per cohort, joined on the cohort key."""
    v = Fixtures(spark, sf).vec.withColumn("cohort", F.col("vec_id") % 3)
    cents = VO.mean_vector(v, ["cohort", "label"], "embedding").withColumnRenamed("label", "topic")
    a = VO.alignment(v.select("vec_id", "cohort", "embedding"), cents, "embedding", by=["cohort"], weighted=True)
    return a.select("vec_id", F.round("alignment", 6).alias("alignment"))


@query("j2_fit_bias_direction")
def j2_fit_bias_direction(spark, sf):
    """Balanced linear SVM on (vector, label): rows are the unit normal's
    components. A learned model: checked by unit norm and sign in tests."""
    t = Fixtures(spark, sf).train_vec
    w = VO.fit_bias_direction(t, "embedding", "says_award")
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "i INT, w DOUBLE")


@query("j2_bias_direction_plane", oracle="""
WITH RECURSIVE base AS (SELECT CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CASE WHEN says_award > 0 THEN 1.0 ELSE -1.0 END AS y,
       count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY says_award > 0)) AS s FROM train_vec WHERE embedding IS NOT NULL AND says_award IS NOT NULL),
newton AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2, CAST(0 AS DOUBLE) AS w3
  UNION ALL
  SELECT k + 1, (r1 * (m22 * m33 - m23 * m23) - m12 * (r2 * m33 - m23 * r3) + m13 * (r2 * m23 - m22 * r3)) / det,
         (m11 * (r2 * m33 - r3 * m23) - r1 * (m12 * m33 - m23 * m13) + m13 * (m12 * r3 - r2 * m13)) / det,
         (m11 * (m22 * r3 - r2 * m23) - m12 * (m12 * r3 - r2 * m13) + r1 * (m12 * m23 - m22 * m13)) / det
  FROM (SELECT *, m11 * (m22 * m33 - m23 * m23) - m12 * (m12 * m33 - m23 * m13) + m13 * (m12 * m23 - m22 * m13) AS det
        FROM (SELECT k, 1 + 2 * sum(s * a * a) AS m11, 2 * sum(s * a * b) AS m12, 2 * sum(s * a) AS m13, 1 + 2 * sum(s * b * b) AS m22,
                     2 * sum(s * b) AS m23, 1 + 2 * sum(s) AS m33, 2 * sum(s * y * a) AS r1, 2 * sum(s * y * b) AS r2, 2 * sum(s * y) AS r3
              FROM newton, base WHERE k < 25 AND y * (w1 * a + w2 * b + w3) < 1 GROUP BY k)))
SELECT 0 AS i, round(w1 / sqrt(w1 * w1 + w2 * w2), 6) AS w FROM newton WHERE k = 25
UNION ALL SELECT 1, round(w2 / sqrt(w1 * w1 + w2 * w2), 6) FROM newton WHERE k = 25
""")
def j2_bias_direction_plane(spark, sf):
    """The same fit over the first two components, small enough for Newton steps in SQL."""
    t = Fixtures(spark, sf).train_vec
    w = VO.fit_bias_direction(t.withColumn("embedding", F.slice("embedding", 1, 2)), "embedding", "says_award")
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(w)], "i INT, w DOUBLE")


@query("j3_debias_fitted")
def j3_debias_fitted(spark, sf):
    """Fit the direction, then project every description vector."""
    fx = Fixtures(spark, sf)
    w = VO.fit_bias_direction(fx.train_vec, "embedding", "says_award")
    out = VO.project_out(fx.vec.select("vec_id", "embedding"), "embedding", w)
    return out.select("vec_id", F.round(V.dot("embedding", VO.lit_vector(w)), 9).alias("residual_on_w"))
