"""Dense vector math on ``array<float|double>`` columns with higher-order
functions (JVM-side, codegen). Vectors stay arrays; nothing is collected and
no matrix is materialised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def sq_norm(a) -> Column:
    return _sum(F.transform(as_double(a), lambda x: x * x))


def l2_norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def unit(a) -> Column:
    n = l2_norm(a)
    return F.transform(as_double(a), lambda x: x / n)


def cosine(a, b) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def linear(a, b) -> Column:
    return dot(a, b)


def sq_distance(a, b) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def rbf(a, b, gamma: float) -> Column:
    """exp(-gamma * ||a - b||^2)."""
    return F.exp(F.lit(-float(gamma)) * sq_distance(a, b))


def scale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(as_double(a), lambda x: x * s)


def subtract(a, b) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def kernel(metric: str, a, b, gamma: float | None = None) -> Column:
    if metric == "cosine":
        return cosine(a, b)
    if metric == "linear":
        return linear(a, b)
    if metric == "rbf":
        return rbf(a, b, 1.0 if gamma is None else gamma)
    raise ValueError(f"unknown metric {metric}")


def round_vec(v, digits: int = 6) -> Column:
    return F.transform(_col(v), lambda x: F.round(x.cast("double"), digits))
