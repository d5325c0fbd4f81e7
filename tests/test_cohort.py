import numpy as np
from pyspark.sql import functions as F

from wreath.operators import cohort as C
from wreath.operators.relational import cohort_total


def cohort_df(spark, n=400):
    rng = np.random.default_rng(3)
    rows = [(i, 2000 + i % 5, float(rng.normal()), int(rng.integers(1, 5)), int(i % 7 == 0))
            for i in range(n)]
    return spark.createDataFrame(rows, "id int, year int, score double, n_nom int, n_win int")


def test_softmax_sums_to_one(spark):
    p = C.cohort_softmax(cohort_df(spark), "year", "score")
    sums = p.groupBy("year").agg(F.sum("p_win").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)


def test_naive_winners_sum_to_cohort_wins(spark):
    df = cohort_total(cohort_df(spark), "year", "n_win", "tot_cohort_awards")
    for buckets in (1, 7):  # one bucket per cohort, and several
        d = C.naive_winners(df, "id", n_nom="n_nom", seed=2, buckets=buckets)
        got = d.groupBy("year").agg(F.sum("naive_wins").alias("w"), F.max("tot_cohort_awards").alias("t")).collect()
        assert all(r.w == r.t for r in got)
    a = C.naive_winners(df, "id", n_nom="n_nom", seed=2).orderBy("id").collect()
    b = C.naive_winners(df, "id", n_nom="n_nom", seed=2).orderBy("id").collect()
    assert a == b


def test_naive_expected_sums(spark):
    df = cohort_total(cohort_df(spark), "year", "n_win", "tot_cohort_awards")
    df = cohort_total(df, "year", "n_nom", "tot_cohort_nom")
    e = C.naive_expected(df, n_nom="n_nom").groupBy("year").agg(
        F.sum("expected_wins").alias("e"), F.max("tot_cohort_awards").alias("t")).collect()
    assert all(abs(r.e - r.t) < 1e-9 for r in e)


def test_pick_winners_matches_brute_force(spark):
    df = cohort_total(cohort_df(spark), "year", "n_win", "tot")
    got = {r.id for r in C.pick_winners(df, "year", "score", "tot", "id").filter("pred_win = 1").collect()}
    pdf = df.toPandas()
    want = set()
    for _, g in pdf.groupby("year"):
        g = g.sort_values(["score", "id"], ascending=[False, True])
        want |= set(g.head(int(g.tot.iloc[0])).id)
    assert got == want


def test_loss_and_kpis(spark):
    df = spark.createDataFrame([(1, 0.5, 1, 1), (1, 0.3, 0, 0), (1, 0.2, 1, 0), (2, 1.0, 2, 1)],
                               "year int, p double, n int, pred int")
    loss = {r.year: r.loss for r in C.multinomial_ce_loss(df, "year", "n", "p").collect()}
    assert abs(loss[1] - (-(np.log(0.5) + np.log(0.2)) / 2)) < 1e-12 and abs(loss[2]) < 1e-12
    k = C.classification_kpis(df, "n", "pred").first()
    assert (k.tp, k.fp, k.fn, k.tn) == (2, 0, 1, 1)
    assert abs(k.f1 - 0.8) < 1e-12 and abs(k.balanced_accuracy - (2 / 3 + 1) / 2) < 1e-12


def test_ranker_learns_signal(spark):
    rng = np.random.default_rng(9)
    rows = []
    for c in range(40):
        xs = rng.standard_normal(6)
        win = int(np.argmax(xs + rng.normal(0, 0.3, 6)))
        rows += [(c, float(x), int(i == win)) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "c int, x double, n int")
    beta = C.fit_cohort_ranker(df, "c", ["x"], "n")
    assert beta[0] > 0.5
