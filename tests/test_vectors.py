import numpy as np
import pytest

from wreath.functions import vectors as V
from wreath.operators import vectors as VO


@pytest.fixture()
def vecs(spark):
    rng = np.random.default_rng(0)
    data = [(i, int(i % 3), rng.standard_normal(8).astype(float).tolist()) for i in range(60)]
    return spark.createDataFrame(data, "id int, label int, v array<double>")


def test_project_out_orthogonal(spark, vecs):
    w = np.random.default_rng(1).standard_normal(8)
    w = (w / np.linalg.norm(w)).tolist()
    out = VO.project_out(vecs, "v", w)
    res = [abs(r.d) for r in out.select(V.dot("v", VO.lit_vector(w)).alias("d")).collect()]
    assert max(res) < 1e-9


def test_project_out_as_written_formula(spark, vecs):
    w = [1.0] + [0.0] * 7
    out = VO.project_out(vecs, "v", w, mode="as_written", out="p").collect()
    for r in out:
        x = np.array(r.v)
        assert np.allclose(r.p, x.sum() - (x @ np.array(w)) * np.array(w))


def test_project_out_dimension_mismatch(spark, vecs):
    with pytest.raises(Exception, match="2 values"):
        VO.project_out(vecs, "v", [1.0, 0.0]).collect()


def test_mean_vector(spark, vecs):
    got = {r.label: np.array(r.centroid) for r in VO.mean_vector(vecs, "label", "v").collect()}
    pdf = vecs.toPandas()
    for lab, g in pdf.groupby("label"):
        assert np.allclose(got[lab], np.stack(g.v).mean(axis=0))


def test_alignment_variants_match_numpy(spark, vecs):
    cents = VO.mean_vector(vecs, "label", "v").withColumnRenamed("label", "topic")
    C = {r.topic: (np.array(r.centroid), r.size) for r in cents.collect()}
    keys = sorted(C)
    M = np.stack([C[k][0] for k in keys])
    wts = np.array([C[k][1] for k in keys], dtype=float)
    wts /= wts.sum()
    X = np.stack(vecs.toPandas().sort_values("id").v)
    cos = (X / np.linalg.norm(X, axis=1)[:, None]) @ (M / np.linalg.norm(M, axis=1)[:, None]).T
    cases = [
        (dict(), cos.sum(1)),
        (dict(p=float("inf")), cos.max(1)),
        (dict(p=2, weighted=True, mod_sim=True), np.sqrt((np.abs(cos) ** 2) @ wts)),
        (dict(metric="linear"), (X @ M.T).sum(1)),
    ]
    for kw, want in cases:
        out = VO.alignment(vecs, cents, "v", **kw).orderBy("id").select("alignment").collect()
        assert np.allclose([r.alignment for r in out], want), kw


def test_alignment_fractional_root_of_negative_is_null(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id int, v array<double>")
    cents = spark.createDataFrame([(0, [-1.0, 0.0], 1)], "topic int, centroid array<double>, size long")
    out = VO.alignment(df, cents, "v", metric="linear", p=3).first()
    assert out.alignment is None


def test_fit_bias_direction_separates(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.standard_normal(6).tolist(), 0) for _ in range(80)] + \
           [((rng.standard_normal(6) + np.array([3, 0, 0, 0, 0, 0])).tolist(), 1) for _ in range(40)]
    df = spark.createDataFrame(rows, "v array<double>, y int")
    w = np.array(VO.fit_bias_direction(df, "v", "y"))
    assert abs(np.linalg.norm(w) - 1) < 1e-9 and w[0] > 0.8


def test_alignment_chunks_do_not_matter(spark, vecs):
    cents = VO.mean_vector(vecs, "id", "v").withColumnRenamed("id", "topic")  # 60 centroids
    for kw in (dict(), dict(p=2, weighted=True, mod_sim=True), dict(p=float("inf"))):
        a = {r.id: r.alignment for r in VO.alignment(vecs, cents, "v", **kw).collect()}
        b = {r.id: r.alignment for r in VO.alignment(vecs, cents, "v", block_bytes=64, pass_bytes=200, **kw).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a), kw


def test_alignment_without_centroids(spark, vecs):
    cents = VO.mean_vector(vecs, "id", "v").withColumnRenamed("id", "topic").limit(0)
    assert {r.alignment for r in VO.alignment(vecs, cents, "v").collect()} == {0.0}
    assert {r.alignment for r in VO.alignment(vecs, cents, "v", p=float("inf")).collect()} == {None}


def test_bias_direction_is_the_minimum_of_the_squared_hinge(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 4)) + np.array([1.0, 0, 0, 0]) * (np.arange(150) % 3 == 0)[:, None]
    y = np.where(np.arange(150) % 3 == 0, 1.0, -1.0)
    df = spark.createDataFrame([(v.tolist(), int(t > 0)) for v, t in zip(x, y)], "v array<double>, y int")
    got = np.array(VO.fit_bias_direction(df, "v", "y"))
    s = np.where(y > 0, 150 / (2 * (y > 0).sum()), 150 / (2 * (y < 0).sum()))
    a, w = np.c_[x, np.ones(150)], np.zeros(5)
    for _ in range(20000):       # plain gradient descent on the same objective
        w -= 5e-4 * (w - 2 * a.T @ (s * y * np.maximum(0, 1 - y * (a @ w))))
    assert np.allclose(got, w[:4] / np.linalg.norm(w[:4]), atol=1e-5)


def test_project_out_keeps_null_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None)], "id int, v array<double>")
    assert VO.project_out(df, "v", [1.0, 0.0, 0.0]).orderBy("id").collect()[1].v is None


def test_alignment_moves_no_vectors(spark, vecs):
    cents = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 0.5], 3) for i in range(4)], "topic int, centroid array<double>, size long")
    df = spark.createDataFrame([(i, [1.0, float(i), 0.0, 1.0]) for i in range(50)], "id int, v array<double>").repartition(3)
    out = VO.alignment(df.select("id", "v"), cents, "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1          # the repartition above


@pytest.mark.parametrize("tasks", [1, 16, 37, 300])
def test_tree_sum(spark, tasks):
    rng = np.random.default_rng(tasks)
    values = rng.standard_normal((tasks, 5))
    blocks = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(values)], VO.TREE_ROWS).repartition(3)
    got = VO.tree_sum(blocks, tasks, 5)
    assert np.allclose(got, values.sum(0), atol=1e-12)
    assert (VO.tree_sum(blocks.repartition(7), tasks, 5) == got).all()      # not a matter of arrival
    assert (VO.tree_sum(blocks.limit(0), tasks, 5) == 0).all()
