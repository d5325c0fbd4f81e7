"""Cohort (yearly shortlist) operators: softmax win probabilities, top-N
winners, the naive multinomial baseline, the multinomial cross-entropy loss,
classification KPIs and a linear conditional-logit ranker."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


# --------------------------------------------------------------------------- E5
def cohort_softmax(df: DataFrame, cohort, score: str, out: str = "p_win", log_out: str | None = None) -> DataFrame:
    """exp(s - max_c s) / Σ_c exp(s - max_c s): shifted for stability, sums to
    1 in every cohort.

    Two small per-cohort aggregates (max, then Σexp) joined back by key: no
    window, so a hot cohort is reduced map-side instead of sorted in one task.
    ``log_out`` adds ln p = s - max - ln Σ, which stays finite where p is 0.
    """
    cohort = _names(cohort)
    mx = df.groupBy(*cohort).agg(F.max(score).alias("__m"))
    x = df.join(mx, cohort, "left").withColumn("__e", F.exp(F.col(score) - F.col("__m")))
    z = x.groupBy(*cohort).agg(F.sum("__e").alias("__z"))
    x = x.join(z, cohort, "left").withColumn(out, F.col("__e") / F.col("__z"))
    if log_out:
        x = x.withColumn(log_out, F.col(score) - F.col("__m") - F.log("__z"))
    return x.drop("__m", "__e", "__z")


# --------------------------------------------------------------------------- E6
def pick_winners(df: DataFrame, cohort, score: str, n_col: str, tie: str, out: str = "pred_win") -> DataFrame:
    """Flag the top ``n_col`` rows of each cohort by score desc, ``tie`` asc.

    A cohort's cut-off score is searched by counting and each row compared with it
    (:func:`wreath.operators.ranges.top_flags`): no cohort is sorted or held in a task."""
    from wreath.operators.ranges import top_flags

    return top_flags(df, _names(cohort), score, n_col, tie, out)


# --------------------------------------------------------------------------- J16
def naive_expected(df: DataFrame, cohort: str = "year", n_nom: str = "n_nom_all",
                   n_awards: str = "tot_cohort_awards", tot_nom: str = "tot_cohort_nom",
                   out: str = "expected_wins") -> DataFrame:
    """Expectation of the naive baseline: N_win * n_nom / Σ n_nom."""
    return df.withColumn(out, F.col(n_awards) * F.try_divide(F.col(n_nom).cast("double"),
                                                             F.col(tot_nom)))


def naive_winners(df: DataFrame, key: str, cohort: str = "year", n_nom: str = "n_nom_all",
                  n_awards: str = "tot_cohort_awards", seed: int = 0,
                  out: str = "naive_wins", buckets: int = 64) -> DataFrame:
    """Draw ``n_awards`` wins per cohort from a multinomial with p ∝ n_nom.

    Exact and skew safe: every cohort is cut into ``buckets`` hash buckets, a
    fixed number (part of the seed: raise it for cohorts of many millions), so
    the draw of a cohort does not change with its size or its partitions. Bucket totals of a multinomial are themselves
    multinomial over bucket weights, and inside a bucket the counts are
    multinomial given the bucket total. So the wins are first split among
    buckets (a tiny table: one row per cohort and bucket), then drawn inside
    each bucket with ``applyInPandas`` over (key, n) only. No task ever holds
    more than one bucket. Seeds derive from (seed, cohort, bucket), so draws
    do not depend on partitioning.
    """
    slim = df.select(F.col(cohort).alias("__c"), F.col(key).alias("__k"),
                     F.coalesce(F.col(n_nom).cast("double"), F.lit(0.0)).alias("__n"),
                     F.coalesce(F.col(n_awards).cast("long"), F.lit(0)).alias("__tot"))
    slim = slim.withColumn("__b", F.pmod(F.xxhash64(F.col("__k")), F.lit(buckets).cast("long")))
    blocks = slim.groupBy("__c", "__b").agg(F.sum("__n").alias("__w"), F.max("__tot").alias("__tot"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__b", kind="mergesort")
        rng = np.random.default_rng([seed, _stable(pdf["__c"].iloc[0]), 1 << 20])
        w = pdf["__w"].to_numpy(dtype=float)
        k = int(pdf["__tot"].max())
        kb = rng.multinomial(k, w / w.sum()) if w.sum() > 0 else np.zeros(len(w), dtype=np.int64)
        return pd.DataFrame({"__c": pdf["__c"].to_numpy(), "__b": pdf["__b"].to_numpy(),
                             "__kb": kb.astype("int64")})

    bsch = T.StructType([slim.schema["__c"], T.StructField("__b", T.LongType()),
                         T.StructField("__kb", T.LongType())])
    kb = blocks.groupBy("__c").applyInPandas(split, bsch)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__k", kind="mergesort")
        rng = np.random.default_rng([seed, _stable(pdf["__c"].iloc[0]), int(pdf["__b"].iloc[0])])
        w = pdf["__n"].to_numpy(dtype=float)
        k = int(pdf["__kb"].iloc[0])
        wins = rng.multinomial(k, w / w.sum()) if w.sum() > 0 else np.zeros(len(w), dtype=np.int64)
        return pd.DataFrame({"__c": pdf["__c"].to_numpy(), "__k": pdf["__k"].to_numpy(),
                             out: wins.astype("int64")})

    schema = T.StructType([slim.schema["__c"], slim.schema["__k"],
                           T.StructField(out, T.LongType())])
    drawn = (slim.select("__c", "__b", "__k", "__n").join(kb, ["__c", "__b"])
             .groupBy("__c", "__b").applyInPandas(draw, schema))
    return df.join(drawn.withColumnRenamed("__c", cohort).withColumnRenamed("__k", key),
                   [cohort, key], "left")


def _stable(v) -> int:
    import zlib
    return zlib.crc32(repr(v).encode()) & 0xFFFFFFFF


# --------------------------------------------------------------------------- J20
def multinomial_ce_loss(df: DataFrame, cohort, n: str, p: str, normalize: bool = True,
                        weight: str | None = None, log_p: str | None = None) -> DataFrame:
    """Per-cohort loss -Σ_i N_i ln p_i / N_win (no 1/N_win when not
    normalised). One aggregate per cohort; rows with N_i = 0 add nothing.
    ``log_p`` names a column of ln p (see :func:`cohort_softmax`), exact where
    p underflows; without it a winner with p = 0 makes the loss infinite.
    ``weight`` (constant per cohort) is carried for :func:`total_loss`."""
    cohort = _names(cohort)
    ln_p = F.col(log_p) if log_p else F.when(F.col(p) > 0, F.log(p)).when(F.col(p) == 0, F.lit(float("-inf")))
    nll = F.sum(F.when(F.col(n) > 0, -F.col(n) * ln_p).otherwise(F.lit(0.0)))
    loss = F.try_divide(nll, F.sum(n).cast("double")) if normalize else nll
    aggs = [loss.alias("loss")]
    if weight:
        aggs.append(F.max(weight).alias(weight))
    return df.groupBy(*cohort).agg(*aggs)


def total_loss(per_cohort: DataFrame, weight: str | None = None) -> DataFrame:
    val = F.col("loss") * F.col(weight) if weight else F.col("loss")
    return per_cohort.agg(F.sum(val).alias("total_loss"))


# --------------------------------------------------------------------------- J21
def classification_kpis(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Balanced accuracy and F1 (positive class 1) from one aggregate."""
    c = df.agg(
        F.count_if((F.col(y) > 0) & (F.col(yhat) > 0)).alias("tp"),
        F.count_if((F.col(y) <= 0) & (F.col(yhat) > 0)).alias("fp"),
        F.count_if((F.col(y) > 0) & (F.col(yhat) <= 0)).alias("fn"),
        F.count_if((F.col(y) <= 0) & (F.col(yhat) <= 0)).alias("tn"))
    tpr = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    tnr = F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))
    f1 = F.try_divide((2 * F.col("tp")).cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn",
                    ((tpr + tnr) / 2).alias("balanced_accuracy"), f1.alias("f1"))


# --------------------------------------------------------------------------- J22
def fit_cohort_ranker(df: DataFrame, cohort, features: Sequence[str], n: str, steps: int = 50,
                      tolerance: float = 1e-9, l2: float = 0.0) -> list[float]:
    """Linear conditional logit: score = x·β, p = softmax of score within the
    cohort; minimises the mean over cohorts of Σ_i N_i/N_c (-ln p_i) (+ l2 |β|²/2 on
    standardised features) by Newton steps until the gradient vanishes; raises when
    ``steps`` do not suffice (separable data have no finite optimum without ``l2``).

    With E and C the mean and covariance of x under p, a cohort's gradient is E - Σ (N_i/N_c) x_i and
    its Hessian C. Each step is one pair of aggregates over the stored rows: a per-cohort maximum, then
    sums of e, e x and e x xᵀ by cohort, reduced to d + d² + 1 numbers. A step that does not lower the loss
    is halved. β enters each step as literals, so plans do not grow."""
    from wreath.session import materialize

    cohort, d = _names(cohort), len(features)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    base = df.select(*cohort, *[value(f).alias(f"x{i}") for i, f in enumerate(features)], value(n).alias("__n"))
    nc = base.groupBy(*cohort).agg(F.sum("__n").alias("__nc"))
    base = base.join(nc.filter(F.col("__nc") > 0), cohort, "inner")
    xs = [f"x{i}" for i in range(d)]
    st = base.agg(*[F.avg(x).alias(f"m_{x}") for x in xs], *[F.stddev_pop(x).alias(f"s_{x}") for x in xs]).first()
    mu, sd = [st[f"m_{x}"] or 0.0 for x in xs], [st[f"s_{x}"] or 1.0 for x in xs]
    z = materialize(base.select(*cohort, (F.col("__n") / F.col("__nc")).alias("__y"), *[((F.col(x) - m) / s).alias(x) for x, m, s in zip(xs, mu, sd)]))
    fixed = z.agg(F.count_distinct(*[F.col(c) for c in cohort]).alias("__C"), *[F.sum(F.col("__y") * F.col(x)).alias(x) for x in xs]).first()
    if not fixed["__C"]:
        raise ValueError("no cohort has a win")
    target = np.array([fixed[x] for x in xs]) / fixed["__C"]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and Hessian."""
        scored = z.withColumn("__s", sum((F.col(x) * float(b) for x, b in zip(xs, beta)), F.lit(0.0)))
        e = scored.join(scored.groupBy(*cohort).agg(F.max("__s").alias("__m")), cohort).withColumn("__e", F.exp(F.col("__s") - F.col("__m")))
        per = e.groupBy(*cohort).agg(F.max("__m").alias("__m"), F.sum("__e").alias("__z"), *[F.sum(F.col("__e") * F.col(x)).alias(x) for x in xs],
                                     *[F.sum(F.col("__e") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i, j in pairs])
        mean = lambda x: F.col(x) / F.col("__z")
        r = per.agg(F.avg(F.col("__m") + F.log("__z")).alias("l"), *[F.avg(mean(x)).alias(x) for x in xs],
                    *[F.avg(mean(f"c{i}_{j}") - mean(f"x{i}") * mean(f"x{j}")).alias(f"c{i}_{j}") for i, j in pairs]).first()
        hessian = np.zeros((d, d))
        for i, j in pairs:
            hessian[i, j] = hessian[j, i] = r[f"c{i}_{j}"]
        return (r["l"] - float(target @ beta) + l2 * float(beta @ beta) / 2, np.array([r[x] for x in xs]) - target + l2 * beta,
                hessian + l2 * np.eye(d))

    beta = np.zeros(d)
    loss, grad, hessian = at(beta)
    for _ in range(steps):
        if np.abs(grad).max() <= tolerance:
            return [float(b / s) for b, s in zip(beta, sd)]       # back to the raw feature scale
        move = np.linalg.lstsq(hessian, grad, rcond=1e-12)[0]
        for _ in range(30):
            tried = at(beta - move)
            if tried[0] <= loss + 1e-12 * abs(loss):
                break
            move = move / 2
        beta, (loss, grad, hessian) = beta - move, tried
    raise RuntimeError(f"the gradient has not vanished after {steps} steps: {np.abs(grad).max():.3g}")
