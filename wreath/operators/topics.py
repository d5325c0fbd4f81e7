"""Topic time series: frequencies per month, filters over those series
(minimum frequency, kurtosis, stationarity), per-cohort k-means topics and
the topicality score of vectors against hot-topic centroids.

Filters take the frequency table (by..., topic, month, frequency) and return
the passing (by..., topic) keys; ``all_of`` intersects them. Series are
12 numbers per topic, so per-topic Python work (the ADF test) runs in
Arrow batches over an already aggregated table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wreath.functions.aggregates import kurtosis_unbiased, ordered_list
from wreath.operators.relational import densify

MONTHLY_FLOOR = 10      # fixed value
Filter = Callable[[DataFrame, Sequence[str]], DataFrame]


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


# --------------------------------------------------------------------------- J5
def topics_over_time(df: DataFrame, by, topic: str, month: str) -> DataFrame:
    """Documents per (by, topic, month): the ``frequency`` series."""
    return df.groupBy(*_names(by), topic, month).agg(F.count(F.lit(1)).cast("bigint").alias("frequency"))


def monthly_series(freq: DataFrame, keys: Sequence[str], month: str = "month",
                   value: str = "frequency") -> DataFrame:
    """Months 1..12 for every key, missing months as 0 (H5)."""
    return densify(freq, list(keys), month, 1, 12, value)


# --------------------------------------------------------------------------- J6
def min_frequency(n: int = MONTHLY_FLOOR) -> Filter:
    """Keep topics with at least one month of ``n`` or more documents."""
    def f(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
        return freq.groupBy(*keys).agg(F.max("frequency").alias("__m")).filter(F.col("__m") >= n).drop("__m")
    return f


# --------------------------------------------------------------------------- J7
def high_kurtosis(threshold: float = 2.0) -> Filter:
    """Keep topics whose 12-month series has sample excess kurtosis above
    ``threshold`` (a burst in few months)."""
    def f(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
        s = monthly_series(freq, keys)
        return (s.groupBy(*keys).agg(kurtosis_unbiased("frequency").alias("__k"))
                .filter(F.col("__k") > threshold).drop("__k"))
    return f


# --------------------------------------------------------------------------- J8
#: a regressor whose remainder is within this share of its square sum lies in the span of those before
#: it, and a residual sum within this share of the total is an exact fit; both end the search for lags
RANK_TOLERANCE = 1e-8


def _regressors(x: np.ndarray, lags: int) -> np.ndarray:
    """Columns constant, trend, squared trend, level, lagged differences 1..lags, and the
    difference itself; the trend runs over [-1, 1], which spans the same and keeps the scales alike."""
    dx = np.diff(x)
    n = len(dx) - lags
    u = np.linspace(-1.0, 1.0, n)
    return np.column_stack([np.ones(n), u, u * u, x[lags: lags + n], *[dx[lags - k: lags - k + n] for k in range(1, lags + 1)], dx[lags:]])


def _swept(columns: np.ndarray):
    """Least squares of the last column on the first 1, 2, ... others: after each regressor the swept
    moment matrix (inverse moments, coefficients, residual sum). Ends before a regressor that lies in
    the span of those before it and after an exact fit."""
    a = columns.T @ columns
    size = a.diagonal().copy()
    for k in range(len(a) - 1):
        if a[k, k] <= RANK_TOLERANCE * size[k]:
            return
        pivot = a[k, k]
        row = a[k] / pivot
        column = a[:, k].copy()
        a = a - np.outer(column, row)
        a[k] = row
        a[:, k] = -column / pivot
        a[k, k] = 1 / pivot
        if a[-1, -1] <= RANK_TOLERANCE * size[-1]:
            return
        yield a


def adf_tau(x: np.ndarray, maxlag: int | None = None, autolag: bool = True) -> tuple[float, int]:
    """Augmented Dickey-Fuller statistic with constant, trend and squared
    trend ('ctt'); lag order by AIC over 0..maxlag (default
    ceil(12 (n/100)^(1/4))), then the t-value of the lagged level.

    Lag orders whose regressors are linearly dependent or fit exactly (within
    ``RANK_TOLERANCE``) have no statistic and are left out: with eleven lags a series of
    period 12 is fitted exactly, and its t-value would be rounding noise. NaN when no
    order is left (a constant series)."""
    x = np.asarray(x, dtype=float)
    if maxlag is None:
        maxlag = int(np.ceil(12.0 * np.power(len(x) / 100.0, 1 / 4.0)))
        maxlag = max(0, min(len(x) // 2 - 4, maxlag))
    if x.std() == 0:
        return float("nan"), 0
    x = (x - x.mean()) / x.std()
    best = maxlag
    if autolag:
        columns = _regressors(x, maxlag)
        n, aic = len(columns), {}
        for k, a in enumerate(_swept(columns)):
            if k >= 3:
                aic[k - 3] = n * math.log(a[-1, -1] / n) + 2 * (k + 1)
        if not aic:
            return float("nan"), 0
        best = min(aic, key=aic.get)
    columns = _regressors(x, best)
    steps = list(_swept(columns))
    if len(steps) < best + 4:
        return float("nan"), best
    a, n = steps[-1], len(columns)
    return float(a[3, -1] / math.sqrt(a[-1, -1] / (n - best - 4) * a[3, 3])), best


# MacKinnon's response surface for the Dickey-Fuller t statistic
# with constant, trend and squared trend (one series). The p-value is the
# normal distribution function of a polynomial in the statistic, one polynomial
# below and one above the switch point.
ADF_MIN, ADF_SWITCH, ADF_MAX = -17.17, -3.21, 0.54
ADF_LOW = (4.0003, 1.658, 0.048288)
ADF_HIGH = (3.0778, 0.49529, -0.41477, -0.059359)


def adf_pvalue(tau: float) -> float:
    """Left-tail p-value of an ADF 'ctt' statistic from the published surface."""
    if np.isnan(tau):
        return float("nan")
    if tau > ADF_MAX:
        return 1.0
    if tau < ADF_MIN:
        return 0.0
    z = sum(c * tau ** i for i, c in enumerate(ADF_LOW if tau <= ADF_SWITCH else ADF_HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def stationary(pvalue_threshold: float = 0.05, n_periods: int = 3) -> Filter:
    """Keep topics whose series, tiled ``n_periods * 12`` times, rejects a
    unit root in an ADF test with constant, trend and squared trend at
    ``pvalue_threshold`` (rejecting series are the ones kept). A constant series has
    no test and is not kept. A tiled series repeats exactly, so lag orders that
    fit it without error are left out (see :func:`adf_tau`)."""
    def f(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
        keys = list(keys)
        reps = n_periods * 12
        s = monthly_series(freq, keys).groupBy(*keys).agg(ordered_list("frequency", "month").alias("__s"))

        def test(pdf: pd.DataFrame) -> pd.DataFrame:
            out = pdf[keys].copy()
            out["pvalue"] = [float("nan") if len(set(x)) < 2 else
                             adf_pvalue(adf_tau(np.tile(np.asarray(x, dtype=float), reps))[0]) for x in pdf["__s"]]
            return out

        schema = T.StructType([freq.schema[k] for k in keys] + [T.StructField("pvalue", T.DoubleType())])
        tested = s.mapInPandas(lambda it: (test(b) for b in it), schema)
        return tested.filter((F.col("pvalue") < pvalue_threshold) & ~F.isnan("pvalue")).select(*keys)
    return f


# --------------------------------------------------------------------------- J15
def all_of(*filters: Filter, base: Filter | None = None) -> Filter:
    """Topics passing every filter (and the minimum-frequency base rule)."""
    base = base or min_frequency()

    def f(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
        out = base(freq, keys)
        for flt in filters:
            out = out.join(flt(freq, keys), list(keys), "inner")
        return out
    return f


def hot_topics(freq: DataFrame, by, topic: str, flt: Filter) -> DataFrame:
    return flt(freq, [*_names(by), topic])


# --------------------------------------------------------------------------- J4
BLOCK_ROWS = 1_024       # most vectors of a block that meets its centroids at once
TASK_BYTES = 64 << 20    # vectors that a task reads in a step
SUMS_BYTES = 32 << 20    # most sums of all tasks that the driver adds up itself


def _topic_sums(data: DataFrame, by: Sequence[str], vec: str, dim: int, cohorts: DataFrame, sizes: Sequence[int]):
    """Function from all centroids (those of the first cohort first, ``sizes`` of each) to the sums and numbers of the
    values that are nearest to each, by dimension. ``cohorts`` numbers the cohorts in ``__cohort``.

    Vectors are stored as blocks of doubles of one cohort. Those with a null value have no distance and belong to the
    first topic of their cohort in every step, so they are summed up once."""
    from wreath.operators.vectors import TREE_ROWS, tree_sum
    from wreath.session import materialize

    spark = data.sparkSession
    first = np.cumsum([0, *sizes])
    shape = (int(first[-1]), dim)
    rows = data.where(F.col(vec).isNotNull()).join(cohorts, list(by)).select("__cohort", vec)
    gap = F.exists(vec, lambda v: v.isNull())

    def pack(batches):
        for batch in batches:
            cohort = batch.column(0).to_numpy()
            order = np.argsort(cohort, kind="stable")
            values = batch.column(1).flatten().to_numpy().reshape(-1, dim)[order]
            of, at = np.unique(cohort[order], return_index=True)
            for c, i, j in zip(of, at, [*at[1:], len(order)]):
                pieces = [values[k: min(k + BLOCK_ROWS, j)].tobytes() for k in range(i, j, BLOCK_ROWS)]
                yield pa.record_batch([pa.array([c] * len(pieces), pa.int32()), pa.array(pieces, pa.binary())], ["cohort", "block"])

    n = rows.count()
    tasks = max(1, -(-n * dim * 8 // TASK_BYTES), min(spark.sparkContext.defaultParallelism, n // BLOCK_ROWS))
    blocks = materialize(rows.where(~gap).mapInArrow(pack, "cohort int, block binary").repartition(tasks))
    parts = blocks.rdd.getNumPartitions()
    still, of_gap = np.zeros((2, *shape))
    sums = [f(F.col(vec)[i]).alias(f"{name}{i}") for name, f in (("s", F.sum), ("n", F.count)) for i in range(dim)]
    for r in rows.where(gap).groupBy("__cohort").agg(*sums).collect():
        t = first[r["__cohort"]]
        still[t], of_gap[t] = [r[f"s{i}"] or 0.0 for i in range(dim)], [r[f"n{i}"] for i in range(dim)]

    def step(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def add(batches):
            from pyspark import TaskContext

            total, told = np.zeros(shape), np.zeros(shape[0])
            for batch in batches:
                for c, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                    x = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, dim)
                    own = slice(first[c], first[c + 1])
                    away = np.empty((len(x), own.stop - own.start))
                    for i, centroid in enumerate(centroids[own]):
                        d = x - centroid
                        away[:, i] = np.einsum("ij,ij->i", d, d)
                    near = away.argmin(axis=1)[:, None] == np.arange(away.shape[1])
                    total[own] += near.T.astype(float) @ x
                    told[own] += near.sum(axis=0)
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes() + told.tobytes()], pa.binary())],
                                  ["part", "block"])

        found, size = blocks.mapInArrow(add, TREE_ROWS), shape[0] * (dim + 1)
        if parts * size * 8 <= SUMS_BYTES:
            rows = sorted(found.collect(), key=lambda r: r["part"])
            both = np.add.reduce([np.frombuffer(r["block"], np.float64) for r in rows]) if rows else np.zeros(size)
        else:
            both = tree_sum(found, parts, size)
        total, told = both[: shape[0] * dim].reshape(shape), both[shape[0] * dim:]
        return total + still, told[:, None] + of_gap

    return step


def fit_topics(df: DataFrame, key: str, vec: str, by: Sequence[str] = (), k: int = 8,
               seed: int = 0, steps: int | None = None):
    """k-means topics per cohort (every cohort in the same job).

    Seeds: the k rows with the smallest hash of (key, seed) per cohort,
    found with a two-phase top-k (no cohort sorted in one task). Each step:
    centroid sets (one row per cohort, a driver-held constant of cohorts x
    k x dim numbers) go to the tasks, every vector meets those of its cohort and picks
    the nearest one, and the new centroids are per-(cohort, topic) mean vectors, until no
    centroid moves, which needs more steps the more vectors there are (``steps``
    bounds them if given, and raises if they do not suffice). The input is stored once, and
    once more as blocks of numbers by cohort for the steps, as there are hundreds of them: a step is
    one stage that reads the blocks and returns one sum a task.

    Returns (assignments: key, by..., topic; centroids: by..., topic,
    centroid, size).
    """
    from wreath.operators.relational import top_n
    from wreath.operators.vectors import vector_dim
    from wreath.session import materialize

    spark = df.sparkSession
    by = list(by)
    cby = by or ["__all"]
    data = df.select(key, *by, F.transform(vec, lambda v: v.cast("double")).alias("__v"))
    if not by:
        data = data.withColumn("__all", F.lit(0))
    data = materialize(data)
    dim = vector_dim(data, "__v")
    seeds = top_n(data.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))), cby, "__h", key, k)
    cents = [(tuple(r[c] for c in cby), i, list(r["__v"]))
             for i, r in enumerate(seeds.select(*cby, "__v").collect())]
    # renumber topics 0..k-1 inside each cohort
    cur: dict[tuple, list] = {}
    for ck, _, v in sorted(cents, key=lambda t: (repr(t[0]), t[1])):
        cur.setdefault(ck, []).append(v)

    key_fields = [data.schema[c] for c in cby]
    set_schema = T.StructType(key_fields + [T.StructField("__c", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def assign(cur_sets):
        rows = [(*ck, vs) for ck, vs in cur_sets.items()]
        sets = spark.createDataFrame(rows, set_schema)
        j = data.join(sets, cby, "inner")
        d = F.transform(F.col("__c"), lambda c, i: F.struct(
            F.aggregate(F.zip_with(F.col("__v"), c, lambda a, b: (a - b) * (a - b)),
                        F.lit(0.0), lambda s, x: s + x).alias("d"), i.alias("i")))
        return j.withColumn("topic", F.array_min(d)["i"]).drop("__c")

    sums_of = _topic_sums(data, cby, "__v", dim, spark.createDataFrame([(*ck, i) for i, ck in enumerate(cur)], T.StructType(
        key_fields + [T.StructField("__cohort", T.IntegerType())])), [len(vs) for vs in cur.values()])
    for _ in count() if steps is None else range(steps):
        sums, told = sums_of(np.array([v for vs in cur.values() for v in vs], float))
        means, at = (sums / np.maximum(told, 1)).tolist(), count()
        upd = {ck: [means[t] if told[t].any() else v for v, t in zip(vs, at)] for ck, vs in cur.items()}  # empty clusters keep their centroid
        if all(np.allclose(upd[c], cur[c]) for c in cur):
            cur = upd
            break
        cur = upd
    else:
        raise RuntimeError(f"k-means did not settle in {steps} steps")

    assigned = assign(cur)
    out = assigned.select(key, *by, "topic")
    sizes = assigned.groupBy(*cby, "topic").agg(F.count(F.lit(1)).cast("bigint").alias("size"))
    crow = [(*ck, t, v) for ck, vs in cur.items() for t, v in enumerate(vs)]
    cdf = spark.createDataFrame(crow, T.StructType(key_fields + [
        T.StructField("topic", T.IntegerType()),
        T.StructField("centroid", T.ArrayType(T.DoubleType()))]))
    cdf = cdf.join(sizes, [*cby, "topic"], "inner")
    if not by:
        cdf = cdf.drop("__all")
    return out, cdf


# --------------------------------------------------------------------------- J29
YEARS = (1959, 2025)      # fixed value: cohorts scored, half-open


def dated_works(works: DataFrame, records: DataFrame, order: Sequence[str], key: str = "work_id", year: str = "year",
                years: tuple[int, int] = YEARS) -> DataFrame:
    """``works`` with the first non-null year of their ``records`` in ``order``; works without
    a year, or with one outside ``years``, are left out. The year is one partial aggregate."""
    from wreath.operators.relational import sort_key

    first = records.where(F.col(year).isNotNull()).groupBy(key).agg(F.min_by(F.col(year), sort_key(order)).alias(year))
    return works.join(first, key, "left").where((F.col(year) >= years[0]) & (F.col(year) < years[1]))


def topicality(docs: DataFrame, key: str, vec: str, by: Sequence[str], topics: DataFrame,
               topic_vec: str, topic: str, month: str, flt: Filter | None = None,
               metric: str = "cosine", p: float = 1, weighted: bool = False,
               mod_sim: bool = False, gamma: float | None = None) -> DataFrame:
    """Score documents against their cohort's hot topics.

    ``topics``: the dated stream (by..., topic, month, topic_vec). Hot topics
    per cohort pass ``flt`` (default: minimum frequency, kurtosis > 2 and
    stationarity at 0.1 over three periods);
    their centroids are mean vectors of their members, weighted by size
    share. A cohort without hot topics scores 0 (an empty sum).
    """
    from wreath.operators.vectors import alignment, mean_vector, vector_dim

    by = list(by)
    dim = vector_dim(docs, vec)
    flt = flt or all_of(high_kurtosis(2.0), stationary(0.1, 3))
    freq = topics_over_time(topics, by, topic, month)
    hot = hot_topics(freq, by, topic, flt)
    members = topics.join(hot, [*by, topic], "left_semi")
    cents = mean_vector(members, [*by, topic], topic_vec, dim=dim)
    scored = alignment(docs.select(key, *by, vec), cents, vec, by=by, metric=metric, p=p,
                       weighted=weighted, mod_sim=mod_sim, gamma=gamma, order=topic)
    has = cents.select(*by).distinct().withColumn("__has", F.lit(True))
    scored = scored.join(has, by, "left")
    empty = F.lit(None).cast("double") if p == float("inf") else F.lit(0.0)
    return scored.select(key, *by, F.when(F.col("__has").isNull(), empty)
                         .otherwise(F.col("alignment")).alias("topicality"))
