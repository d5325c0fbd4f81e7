"""As-of scan, selection by rank and top-N flags against plain Python, with hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wreath.operators import ranges as RG


@pytest.fixture(params=[(1, 100_000), (9, 0), (9, 30)])
def parts(spark, request, monkeypatch):
    monkeypatch.setattr(RG, "SORT_ROWS", request.param[1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("strict", [True, False])
def test_asof_scan(spark, parts, strict):
    rng = random.Random(1)
    key = lambda: rng.choice([1] * 6 + [2, 3, 4, None])          # noqa: E731  one key has most rows
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(400)]
    right = [(key(), rng.choice([None, *range(60)]), rng.choice([None, *range(1000)])) for _ in range(40)] + [(1, t, t * 10) for t in range(20, 30)]
    l, r = spark.createDataFrame(left, "value int, k int, key int"), spark.createDataFrame(right, "k int, row int, v int")
    got = {x["value"]: x["v"] for x in RG.asof_scan(l, r, ["k"], "key", "row", ["v"], strict).collect()}
    want = {}
    for i, k, t in left:
        ok = [(rt, rv is not None, rv or 0, rv) for rk, rt, rv in right if k is not None and t is not None and rk == k and rt is not None
              and (rt < t if strict else rt <= t)]
        want[i] = max(ok, key=lambda x: x[:3])[3] if ok else None
    assert got == want and len(got) == len(left)


def test_asof_scan_without_rows(spark):
    l, r = spark.createDataFrame([(1, 5)], "k int, t int"), spark.createDataFrame([], "k int, s int, v string")
    assert [tuple(x) for x in RG.asof_scan(l, r, ["k"], "t", "s", ["v"]).collect()] == [(1, 5, None)]
    assert RG.asof_scan(l.limit(0), r, ["k"], "t", "s", ["v"]).collect() == []


def test_exact_quantiles(spark, parts):
    rng = random.Random(2)
    rows = [("hot", rng.gauss(0, 1e6)) for _ in range(900)] + [("a", float(x)) for x in (3, 1, 2)] + [("b", 5.0)] * 4 + [("c", None), (None, -1.5), (None, 2.5), ("z", -0.0), ("z", 0.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    q = [0, 0.1, 0.25, 0.5, 0.75, 1]
    got = {r["g"]: [r[f"q{i}"] for i in range(len(q))] for r in RG.exact_quantiles(df, ["g"], "x", q).collect()}
    for g in {r[0] for r in rows}:
        xs = [x for h, x in rows if h == g and x is not None]
        assert got[g] == ([None] * len(q) if not xs else pytest.approx(list(np.quantile(xs, q)), rel=1e-12, abs=1e-12))
    whole = RG.exact_quantiles(df, [], "x", [0.5]).first()[0]
    assert whole == pytest.approx(np.median([x for _, x in rows if x is not None]))


def test_top_flags(spark, parts):
    rng = random.Random(3)
    rows = [(i, rng.choice([1] * 5 + [2, 3, None]), rng.choice([None, 0.5, 1.5, -2.0, rng.random()])) for i in range(500)]
    n = {1: 60, 2: 0, 3: 1000, None: 5}
    df = spark.createDataFrame([(i, c, s, n[c]) for i, c, s in rows], "id int, c int, s double, n int").repartition(4)
    got = {r["id"]: r["w"] for r in RG.top_flags(df, ["c"], "s", "n", "id", "w").collect()}
    want = {}
    for c in n:
        mine = sorted([(s is None, -(s or 0), i) for i, k, s in rows if k == c])
        want |= {i: int(at < n[c]) for at, (_, _, i) in enumerate(mine)}
    assert got == want


def test_keys_order_like_doubles(spark):
    xs = [float("-inf"), -1e300, -2.5, -1e-300, 0.0, 1e-300, 2.5, 1e300, float("inf"), float("nan")]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").withColumn("k", RG.double_key(F.col("x"))).orderBy("k").collect()
    assert [r["i"] for r in rows] == list(range(len(xs)))
