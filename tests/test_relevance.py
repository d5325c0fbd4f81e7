"""Nearest-neighbour mutual information against a plain version over all pairs."""

import hashlib
import math
import random

import numpy as np
import pytest

from wreath.operators import relevance as RV


def digamma(n):
    return -0.57721566490153286061 + math.fsum(1 / i for i in range(1, n))


def steps(values, ids, name):
    sd = np.std(np.array(values, float))
    return [math.floor(v / sd * 2.0 ** 44) + int(hashlib.md5(f"{i}:{name}".encode()).hexdigest()[:5], 16) - 2 ** 19 for v, i in zip(values, ids)]


def plain(rows, k):
    x, y = (np.array(steps([r[c] for r in rows], [r[0] for r in rows], n), np.int64) for c, n in ((1, "f"), (2, "t")))
    dx, dy = abs(x[:, None] - x), abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.iinfo(np.int64).max)
    r = np.maximum(np.sort(d, 1)[:, k - 1] - 1, 0)[:, None]
    n = len(rows)
    terms = math.fsum(digamma(int(a)) + digamma(int(b)) for a, b in zip((dx <= r).sum(1), (dy <= r).sum(1)))
    return max(0.0, digamma(n) + digamma(k) - terms / n)


def made(kind):
    rng = random.Random(kind)
    if kind == "related":
        return [(i, v, v + rng.gauss(0, 0.5)) for i in range(900) for v in [rng.gauss(0, 1)]]
    if kind == "unrelated":
        return [(i, rng.random(), rng.gauss(0, 3)) for i in range(700)]
    if kind == "ties":        # half of all rows are equal in both columns, the rest in one
        return [(i, 0.0 if i % 2 else float(rng.randrange(7)), 0.0 if i % 2 else float(rng.randrange(3))) for i in range(800)]
    return [(i, rng.gauss(0, 1) if i % 50 else 1e6 * i, float(rng.randrange(4)) ** 9) for i in range(600)]       # far outliers


@pytest.mark.parametrize("kind", ["related", "unrelated", "ties", "outliers"])
@pytest.mark.parametrize("parts", [1, 13])
def test_equals_plain_python(spark, kind, parts):
    rows = made(kind)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = RV.nearest_mutual_information(spark.createDataFrame(rows, "id long, f double, t double").repartition(3), ["f"], "t", "id").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got["n"] == len(rows)
    assert got["mi"] == pytest.approx(plain(rows, 3), abs=1e-9)
    if kind == "related":
        assert got["mi"] == pytest.approx(0.5 * math.log(1 + 1 / 0.25), abs=0.15)       # known for Gaussians


def test_undefined_cases(spark):
    schema = "id long, f double, g double, t double"
    rows = [(i, None if i % 2 else float(i), 1.0, float(i)) for i in range(6)] + [(9, float("nan"), 1.0, 2.0), (None, 3.0, 1.0, 2.0)]
    got = {r["feature"]: (r["n"], r["mi"]) for r in RV.nearest_mutual_information(spark.createDataFrame(rows, schema), ["f", "g"], "t", "id").collect()}
    assert got == {"f": (3, None), "g": (7, 0.0)}
    assert RV.nearest_mutual_information(spark.createDataFrame([], schema), ["f"], "t", "id").first()["mi"] is None


def test_searches_blocks_and_edges():
    rng = np.random.default_rng(4)
    x, y = rng.integers(-1000, 1000, (2, 2000))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    d = np.maximum(abs(x[:, None] - x), abs(y[:, None] - y))
    np.fill_diagonal(d, RV.FAR)
    assert (RV.nearest(x, y, x, y, 4, own=True) == np.sort(d, 1)[:, :4]).all()
    assert (RV.nearest(x[:2], y[:2], x[:2], y[:2], 3, own=True)[:, 1:] == RV.FAR).all()


def test_digamma(spark):
    got = [r[0] for r in spark.range(1, 60).select(RV.digamma(RV.F.col("id"))).collect()]
    assert got == pytest.approx([digamma(n) for n in range(1, 60)], abs=1e-12)
