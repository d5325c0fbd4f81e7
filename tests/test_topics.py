import numpy as np
from pyspark.sql import functions as F

from wreath.functions.aggregates import kurtosis_unbiased
from wreath.operators import topics as TP


def sample_excess_kurtosis(x):
    x = np.asarray(x, float)
    n = len(x)
    m2 = ((x - x.mean()) ** 2).mean()
    m4 = ((x - x.mean()) ** 4).mean()
    g2 = m4 / m2 ** 2 - 3
    return ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))


def test_kurtosis_unbiased(spark):
    series = [0, 0, 0, 15, 0, 0, 0, 0, 0, 0, 1, 0]
    df = spark.createDataFrame([(float(v),) for v in series], "x double")
    got = df.agg(kurtosis_unbiased("x").alias("k")).first().k
    assert abs(got - sample_excess_kurtosis(series)) < 1e-9
    const = spark.createDataFrame([(1.0,)] * 12, "x double").agg(kurtosis_unbiased("x").alias("k")).first().k
    assert const is None


def test_filters(spark):
    rows = [("t", "burst", 3, 40)] + [("t", "flat", m, 5 + m % 3) for m in range(1, 13)]
    freq = spark.createDataFrame(rows, "year string, topic string, month int, frequency long")
    keys = ["year", "topic"]
    assert {r.topic for r in TP.min_frequency(10)(freq, keys).collect()} == {"burst"}
    assert {r.topic for r in TP.high_kurtosis(2)(freq, keys).collect()} == {"burst"}
    assert {r.topic for r in TP.all_of(TP.high_kurtosis(2))(freq, keys).collect()} == {"burst"}


def test_adf_separates_walk_from_stationary():
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.standard_normal(432))
    ar = np.zeros(432)
    for t in range(1, 432):
        ar[t] = 0.3 * ar[t - 1] + rng.standard_normal()
    assert TP.adf_pvalue(TP.adf_tau(ar)[0]) < 0.01 < TP.adf_pvalue(TP.adf_tau(walk)[0])


def test_fit_topics_recovers_clusters(spark):
    rng = np.random.default_rng(5)
    centers = np.array([[5, 0, 0], [0, 5, 0], [0, 0, 5]], float)
    rows = []
    for i in range(300):
        c = i % 3
        rows.append((i, 2000 + (i % 2), (centers[c] + rng.standard_normal(3) * 0.3).tolist(), c))
    df = spark.createDataFrame(rows, "id int, year int, v array<double>, truth int")
    assigned, cents = TP.fit_topics(df, "id", "v", by=["year"], k=3, seed=1)
    j = assigned.join(df.select("id", "truth"), "id").groupBy("year", "topic").agg(
        F.count_distinct("truth").alias("n"))
    assert all(r.n == 1 for r in j.collect())
    assert cents.count() == 6


def test_adf_does_not_hang_on_rounding():
    """Lag orders that fit a tiled series exactly are left out, so a tiny change of scale changes next to nothing."""
    rng = np.random.default_rng(6)
    for _ in range(20):
        x = np.tile(rng.integers(0, 30, 12).astype(float), 36)
        (a, lag), (b, again) = TP.adf_tau(x), TP.adf_tau(x * (1 + 1e-12))
        assert lag == again < 11 and abs(a - b) < 1e-4 * abs(a)
    assert np.isnan(TP.adf_tau(np.full(432, 7.0))[0])


def test_adf_against_least_squares():
    """The swept regression gives the t-value of an ordinary one."""
    rng = np.random.default_rng(7)
    x = np.cumsum(rng.standard_normal(120)) + 0.3 * rng.standard_normal(120)
    tau, lag = TP.adf_tau(x, maxlag=3, autolag=False)
    dx = np.diff(x)
    n = len(dx) - 3
    t = np.arange(n)
    design = np.column_stack([np.ones(n), t, t * t, x[3: 3 + n], dx[2: 2 + n], dx[1: 1 + n], dx[:n]])
    beta, ssr = np.linalg.lstsq(design, dx[3:], rcond=None)[:2]
    se = np.sqrt(ssr[0] / (n - 7) * np.linalg.inv(design.T @ design)[3, 3])
    assert lag == 3 and abs(tau - beta[3] / se) < 1e-6


def test_first_year_of_works(spark):
    works = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "work_id int, v string")
    records = spark.createDataFrame([(1, 2001, 2), (1, 2000, 3), (2, 1950, 1), (3, None, 1), (3, 2024, 2)], "work_id int, year int, n int")
    got = {r["work_id"]: r["year"] for r in TP.dated_works(works, records, ["n"]).collect()}
    assert got == {1: 2001, 3: 2024}


def test_fit_topics_goes_on_until_no_centroid_moves(spark, monkeypatch):
    """More vectors need more than a hundred steps."""
    calls = []
    monkeypatch.setattr(TP.np, "allclose", lambda *_: calls.append(1) or len(calls) > 101)
    df = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "id long, v array<double>")
    assigned, _ = TP.fit_topics(df, "id", "v", k=2)
    assert assigned.count() == 6 and len(calls) == 102
