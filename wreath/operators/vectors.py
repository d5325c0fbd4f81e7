"""Vector operators: centroids, bias direction and projection, alignment.

Vectors are ``array<float|double>`` columns. Sets of centroids are small,
bounded constants (topics x dimensions); they travel either as literal
arrays inside expressions or as one row per cohort joined on the cohort key,
so no cross join and no per-pair row is ever produced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wreath.functions import vectors as V


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def vector_dim(df: DataFrame, vec: str) -> int:
    """Length of the vectors; raises unless all have the same."""
    row = df.where(F.col(vec).isNotNull()).agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError("no vectors")
    if row["lo"] != row["hi"]:
        raise ValueError(f"vectors of {row['lo']} to {row['hi']} values in one column")
    return int(row["lo"])


def lit_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


# --------------------------------------------------------------------------- D26
def mean_vector(df: DataFrame, by, vec: str, dim: int | None = None, out: str = "centroid",
                count: str | None = "size") -> DataFrame:
    """Element-wise mean vector per group.

    One hash aggregate with ``dim`` running sums (partial + final), no
    explode: per map task the state is one row of ``dim`` doubles per group.
    """
    by = _names(by)
    dim = dim or vector_dim(df, vec)
    x = F.col(vec)
    aggs = [F.avg(x[i].cast("double")).alias(f"__m{i}") for i in range(dim)]
    if count:
        aggs.append(F.count(F.lit(1)).cast("bigint").alias(count))
    g = df.filter(x.isNotNull()).groupBy(*by).agg(*aggs)
    return g.select(*by, F.array(*[F.col(f"__m{i}") for i in range(dim)]).alias(out),
                    *([count] if count else []))


# --------------------------------------------------------------------------- J2
TREE_ROWS = "part long, block binary"
TREE_WAYS = 16           # blocks that one task of a round adds up


def tree_rounds(blocks: DataFrame, tasks: int, ways: int = TREE_WAYS) -> DataFrame:
    """One (part, block) from ``tasks`` of them with parts from 0: in each round a task adds up ``ways`` neighbouring blocks
    of doubles in the order of their parts, so the sum does not depend on which arrives first. Each block is shuffled
    once a round, as one row."""
    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        total = np.add.reduce([np.frombuffer(b.as_py(), np.float64) for b in rows["block"]])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([total.tobytes()], pa.binary())})

    while tasks > 1:
        blocks = blocks.groupBy(F.expr(f"part div {ways}").alias("into")).applyInArrow(add, TREE_ROWS)
        tasks = -(-tasks // ways)
    return blocks


def tree_sum(blocks: DataFrame, tasks: int, size: int) -> np.ndarray:
    """Sum of the blocks, ``size`` doubles each; zeros without any."""
    found = tree_rounds(blocks, tasks).select("block").collect()
    return np.frombuffer(found[0]["block"], np.float64).copy() if found else np.zeros(size)


def fit_bias_direction(df: DataFrame, vec: str, label: str, c: float = 1.0, steps: int = 60,
                       tolerance: float = 1e-8) -> list[float]:
    """Unit normal of the class-balanced linear SVM separating ``label``:
    minimises |w|²/2 + b²/2 + C Σ s_i max(0, 1 - y_i (w·x_i + b))², s_i the
    balanced weight n / (2 n_c) (squared hinge on raw features).

    Newton steps: with the active rows (margin below 1) fixed, the minimum
    solves a linear system whose matrix Σ s x xᵀ and right side Σ s y x are one
    aggregate over the rows, (dim + 1)² numbers: one binary block a task, summed up
    in a tree (:func:`tree_sum`). Raises if the gradient has not
    vanished after ``steps``."""
    from wreath.operators.stats import balanced_weights
    from wreath.session import materialize

    d = vector_dim(df, vec)
    data = materialize(balanced_weights(df.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(vec, label), label, out="__s").select(
        V.as_double(vec).alias("x"), F.when(F.col(label).cast("double") > 0, 1.0).otherwise(-1.0).alias("y"), F.col("__s").alias("s")))
    tasks = data.rdd.getNumPartitions()

    def totals(w):
        def part(batches):
            from pyspark import TaskContext

            gram, right, grad, loss = np.zeros((d + 1, d + 1)), np.zeros(d + 1), np.zeros(d + 1), 0.0
            for b in batches:
                x = np.c_[b["x"].flatten().to_numpy().reshape(b.num_rows, d), np.ones(b.num_rows)]
                y, s = b["y"].to_numpy(), b["s"].to_numpy()
                slack = 1 - y * (x @ w)
                on = slack > 0
                xs = x[on] * s[on, None]
                gram += xs.T @ x[on]
                right += xs.T @ y[on]
                grad -= 2 * xs.T @ (y[on] * slack[on])
                loss += float((s[on] * slack[on] ** 2).sum())
            found = np.concatenate([gram.ravel(), right, grad, [loss]])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([found.tobytes()])], ["part", "block"])

        t = tree_sum(data.mapInArrow(part, TREE_ROWS), tasks, (d + 1) * (d + 3) + 1)
        k = (d + 1) ** 2
        return t[:k].reshape(d + 1, d + 1), t[k: k + d + 1], t[k + d + 1: -1], t[-1]

    w = np.zeros(d + 1)
    gram, right, grad, loss = totals(w)
    for _ in range(steps):
        full = w + c * grad
        if np.abs(full).max() <= tolerance * max(1.0, c * np.abs(right).max()):
            break
        move = np.linalg.solve(np.eye(d + 1) + 2 * c * gram, 2 * c * right) - w
        value, step = 0.5 * w @ w + c * loss, 1.0
        while True:                    # halve the step until the objective falls
            gram, right, grad, loss = totals(w + step * move)
            if 0.5 * (w + step * move) @ (w + step * move) + c * loss <= value + 1e-12 * abs(value) or step < 1e-6:
                break
            step /= 2
        w = w + step * move
    else:
        raise RuntimeError(f"the SVM did not settle in {steps} steps")
    n = np.linalg.norm(w[:d])
    return (w[:d] / n).tolist() if n > 0 else w[:d].tolist()


# --------------------------------------------------------------------------- J3
def project_out(df: DataFrame, vec: str, w: Sequence[float], mode: str = "orthogonal",
                out: str | None = None) -> DataFrame:
    """Remove direction ``w`` from every vector.

    ``orthogonal``: x - (x·w) w, the projection onto w's null space (w unit).
    ``as_written``: the reference's arithmetic, x·(1 - w wᵀ), i.e. every
    component j becomes Σx - (x·w) w_j (quirk Q2).
    A dimension mismatch raises, as the reference does.
    """
    wl = lit_vector(w)
    # checked row by row while it runs: no extra pass over the vectors
    xd = F.when(F.size(vec) == len(w), V.as_double(vec)).when(F.col(vec).isNotNull(), F.raise_error(F.concat(
        F.lit(f"the direction has {len(w)} values, a vector has "), F.size(vec).cast("string"))).cast("array<double>"))
    proj = V.dot(xd, wl)
    if mode == "orthogonal":
        res = F.zip_with(xd, wl, lambda x, wi: x - proj * wi)
    elif mode == "as_written":
        total = F.aggregate(xd, F.lit(0.0), lambda a, x: a + x)
        res = F.transform(wl, lambda wi: total - proj * wi)
    else:
        raise ValueError(mode)
    return df.withColumn(out or vec, res)


# --------------------------------------------------------------------------- C16 / J14
BLOCK_BYTES = 64 << 20       # a block of centroids that is sent to the tasks as one matrix
PASS_BYTES = 256 << 20       # blocks that one pass over the vectors meets


def _centroid_blocks(centroids: DataFrame, centroid: str, weight: Column, order: str, dim: int, block_bytes: int):
    """Matrices of centroids with their weights, each of about ``block_bytes``, fetched one by one."""
    n = centroids.count()
    blocks = max(1, -(-n * dim * 8 // block_bytes))
    kept = centroids.select(F.col(order).alias("o"), V.as_double(centroid).alias("c"), weight.cast("double").alias("w"),
                            F.pmod(F.xxhash64(F.col(order)), F.lit(blocks)).alias("b"))
    if blocks > 1:
        from wreath.session import materialize
        kept = materialize(kept)
    for b in range(blocks):
        t = kept.where(F.col("b") == b).orderBy("o").select("c", "w").toArrow().combine_chunks()
        if t.num_rows:
            flat = t["c"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            yield flat.reshape(t.num_rows, -1), t["w"].to_numpy()


def _block_udf(spark, matrix: np.ndarray, weights: np.ndarray, metric: str, p: float, weighted: bool, mod_sim: bool, gamma: float | None):
    """Sum of powers (or maximum) of a vector's similarities with one block."""
    shared = spark.sparkContext.broadcast((matrix, weights))

    def block(vectors: pa.Array) -> pa.Array:
        c, w = shared.value
        known = vectors.is_valid().to_numpy(zero_copy_only=False)
        x = np.asarray(vectors.drop_null().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, c.shape[1])
        out = np.full(len(vectors), np.nan)
        step = max(1, (8 << 20) // (8 * len(c)))               # similarities of some rows at a time
        parts = []
        for a in range(0, len(x), step):
            v = x[a: a + step]
            s = v @ c.T
            if metric == "cosine":
                s /= np.sqrt((v * v).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :]
            elif metric == "rbf":
                s = np.exp(-(1.0 if gamma is None else gamma) * np.maximum(0.0, (v * v).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * s))
            s = np.abs(s) if mod_sim else s
            parts.append(s.max(1) if p == float("inf") else (s if p == 1 else s ** p) @ (w if weighted else np.ones(len(w))))
        if parts:
            out[known] = np.concatenate(parts)
        return pa.array(out, mask=~known)

    return F.arrow_udf(block, "double")


def _terms(cents: Column, x: Column, x_norm: Column, metric: str, gamma: float | None, mod_sim: bool):
    """Similarity of ``x`` with a struct(centroid, weight, norm); cosine divides
    by norms computed once per vector and once per centroid."""
    def sim(c):
        s = V.dot(x, c["centroid"]) / (x_norm * c["norm"]) if metric == "cosine" else V.kernel(metric, x, c["centroid"], gamma)
        return F.abs(s) if mod_sim else s
    return sim


def _partial(cents: Column, x: Column, x_norm: Column, metric: str, p: float, weighted: bool, mod_sim: bool,
             gamma: float | None) -> Column:
    """Largest similarity (p = inf) or sum of powers over an array of centroids."""
    sim = _terms(cents, x, x_norm, metric, gamma, mod_sim)
    if p == float("inf"):
        return F.array_max(F.transform(cents, sim))
    terms = F.transform(cents, lambda c: F.pow(sim(c), F.lit(float(p))) * (c["weight"] if weighted else F.lit(1.0)))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def _rooted(total: Column, p: float) -> Column:
    """p-norm of a sum of powers; a negative base under a fractional root is NaN
    in numpy and null here. Without centroids the sum is 0 and the maximum null."""
    if p == float("inf"):
        return total
    total = F.coalesce(total, F.lit(0.0))
    res = total if p == 1 else F.pow(total, F.lit(1.0 / float(p)))
    return F.when(~F.isnan(res), res)


def centroid_sets(centroids: DataFrame, by: Sequence[str], centroid: str = "centroid",
                  size: str | None = "size", order: str = "topic", weight: Column | None = None) -> DataFrame:
    """One row per ``by`` key: the ordered array of struct(centroid, weight,
    norm), weight = topic size / total size of the key (topic share)."""
    if weight is None:
        weight = F.col(size) / F.sum(size).over(Window.partitionBy(*by)) if size else F.lit(1.0)
    c = centroids.withColumn("__wt", weight.cast("double"))
    return c.groupBy(*by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                             V.as_double(centroid).alias("centroid"),
                                             F.col("__wt").alias("weight"),
                                             V.l2_norm(centroid).alias("norm")))),
        lambda s: F.struct(s["centroid"].alias("centroid"), s["weight"].alias("weight"),
                           s["norm"].alias("norm"))).alias("__cents"))


def alignment(vectors: DataFrame, centroids: DataFrame, vec: str, by: Sequence[str] = (),
              metric: str = "cosine", p: float = 1, weighted: bool = False,
              mod_sim: bool = False, gamma: float | None = None, out: str = "alignment",
              centroid: str = "centroid", size: str | None = "size", order: str = "topic",
              block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Score every vector against the centroids of its ``by`` key (or all
    centroids when ``by`` is empty): (Σ_k s_k^p [w_k])^(1/p) with similarity s
    (abs'ed when ``mod_sim``) and topic share w; p = inf gives max_k s_k.

    With ``by``: centroid sets are collapsed to one row per key and joined on
    the key. Without: the vectors stay where they are and blocks of centroids come to
    them as matrices of at most ``block_bytes``; partial sums or maxima are combined in the
    row. Blocks of ``pass_bytes`` in all are met in one pass; if there are more, the
    rows are stored with what they have so far and passed again, so what tasks hold is bounded.
    No centroids (and a null vector) give 0, or null for p = inf.
    """
    by = list(by)
    if metric not in ("cosine", "linear", "rbf"):
        raise ValueError(f"unknown metric {metric}")
    if by:
        x, norm = V.as_double(F.col(vec)), F.col("__norm")
        partial = _partial(F.col("__cents"), x, norm, metric, p, weighted, mod_sim, gamma)
        j = vectors.withColumn("__norm", V.l2_norm(vec)).join(centroid_sets(centroids, by, centroid, size, order), by, "left")
        return j.withColumn(out, _rooted(partial, p)).drop("__cents", "__norm")
    from wreath.session import materialize

    total = centroids.agg((F.sum(size) if size else F.count(F.lit(1))).alias("t"), F.max(F.size(centroid)).alias("d")).first()
    weight = F.col(size) / F.lit(float(total["t"] or 1)) if size else F.lit(1.0)
    infinite, passed = p == float("inf"), 0
    result = vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("r"), F.lit(None).cast("double").alias("s"))
    for matrix, weights in _centroid_blocks(centroids, centroid, weight, order, total["d"] or 0, block_bytes) if total["d"] else ():
        if passed and passed + matrix.nbytes > pass_bytes:
            result, passed = materialize(result), 0
        passed += matrix.nbytes
        part = _block_udf(vectors.sparkSession, matrix, weights, metric, p, weighted, mod_sim, gamma)(F.transform(F.col("r")[vec], lambda x: x.cast("double")))
        both = F.greatest(F.col("s"), F.col("part")) if infinite else F.coalesce(F.col("s"), F.lit(0.0)) + F.col("part")
        result = result.select("r", "s", part.alias("part")).select("r", both.alias("s"))
    return result.select("r.*", _rooted(F.col("s"), p).alias(out))


# --------------------------------------------------------------------------- K5
from pyspark import keyword_only  # noqa: E402
from pyspark.ml import Transformer  # noqa: E402
from pyspark.ml.param import Param, Params, TypeConverters  # noqa: E402
from pyspark.ml.param.shared import HasInputCol, HasOutputCol  # noqa: E402
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable  # noqa: E402


class DirectionRemover(Transformer, HasInputCol, HasOutputCol,
                         DefaultParamsReadable, DefaultParamsWritable):
    """Spark ML transformer removing a fitted normal direction from an array
    column (the fit/transform surface of :func:`project_out`)."""

    normal = Param(Params._dummy(), "normal", "unit normal vector to project out",
                   typeConverter=TypeConverters.toListFloat)
    mode = Param(Params._dummy(), "mode", "orthogonal | as_written",
                 typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, normal=None, mode="orthogonal"):
        super().__init__()
        self._setDefault(mode="orthogonal")
        self._set(**self._input_kwargs)

    def _transform(self, df):
        return project_out(df, self.getInputCol(), self.getOrDefault(self.normal),
                           mode=self.getOrDefault(self.mode), out=self.getOutputCol())
