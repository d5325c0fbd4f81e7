"""Topics by density: planted clusters, noise, and a plain-Python twin."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wreath.operators import density as DT


def planted(seed=0, years=(2000, 2001)):
    """Clusters of unequal density and size, and scattered points; (id, year, vector, truth)."""
    rng, rows = np.random.default_rng(seed), []
    for year in years:
        for c, (mid, width, n) in enumerate([((0, 0, 0), 0.15, 80), ((6, 0, 0), 0.8, 70), ((0, 8, 0), 0.4, 40)]):
            rows += [(year, (np.array(mid) + width * rng.standard_normal(3)).tolist(), c) for _ in range(n)]
        rows += [(year, rng.uniform(-30, 30, 3).tolist(), -1) for _ in range(25)]
    return [(i, *r) for i, r in enumerate(rows)]


def brute_topics(vectors, min_size=10, k=None, prominence=1.5, spread=2.0):
    """Topic of each distinct vector of one cohort (as sets of members)."""
    x = np.array(vectors)
    n, k = len(x), k or min_size
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, : min(k, n - 1)]
    core = np.take_along_axis(d, near, 1).max(1)
    up = np.arange(n)
    for i in range(n):
        j = min(near[i], key=lambda j: core[j])
        up[i] = j if core[j] < core[i] else i
    root = np.arange(n)
    for i in range(n):
        while up[root[i]] != root[i]:
            root[i] = up[root[i]]
    saddles = {}
    for i in range(n):
        for j in near[i]:
            a, b = root[i], root[j]
            if a != b:
                h = max(core[i], core[j], d[i, j])
                for e in ((a, b), (b, a)):
                    saddles[e] = min(h, saddles.get(e, np.inf))
    end = {r: r for r in root}
    while True:
        moves = {}
        for a in {e[0] for e in saddles}:
            h, b = min((h, b) for (x_, b), h in saddles.items() if x_ == a)
            if core[b] < core[a] and h < prominence * core[a]:
                moves[a] = b
        if not moves:
            break
        def final(r):
            while r in moves:
                r = moves[r]
            return r
        end = {r: final(e) for r, e in end.items()}
        merged = {}
        for (a, b), h in saddles.items():
            a, b = final(a), final(b)
            if a != b:
                merged[a, b] = min(h, merged.get((a, b), np.inf))
        saddles = merged
    ends = np.array([end[r] for r in root])
    topics = set()
    for e in set(ends):
        c = np.sort(core[ends == e])
        middle = c[(len(c) + 1) // 2 - 1]
        m = np.flatnonzero((ends == e) & (core <= spread * middle))
        if len(m) >= min_size:
            topics.add(frozenset(m.tolist()))
    return topics


@pytest.fixture(scope="module")
def found(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "id int, year int, v array<double>, truth int").repartition(3)
    topics, centroids = DT.density_topics(df, "id", "v", by=["year"])
    return rows, {r["id"]: r["topic"] for r in topics.collect()}, centroids.collect()


def test_planted_clusters_and_noise(found):
    rows, topic, centroids = found
    assert len(topic) == len(rows)
    for year in (2000, 2001):
        names = []
        for c in range(3):
            got = [topic[i] for i, y, _, t in rows if y == year and t == c]
            name = max(set(got), key=got.count)
            assert name >= 0 and got.count(name) >= 0.85 * len(got)
            names.append(name)
        assert len(set(names)) == 3 and sum(c["year"] == year for c in centroids) == 3
        scattered = [topic[i] for i, y, _, t in rows if y == year and t == -1]
        assert scattered.count(-1) >= 0.9 * len(scattered)


def test_equals_plain_python(found):
    rows, topic, _ = found
    for year in (2000, 2001):
        mine = [r for r in rows if r[1] == year]
        got = {}
        for at, r in enumerate(mine):
            got.setdefault(topic[r[0]], set()).add(at)
        assert {frozenset(m) for t, m in got.items() if t >= 0} == brute_topics([r[2] for r in mine])


def test_cells_cover_the_near_ones(spark):
    """Cut into cells and blocks, nearly all true neighbours are still found; in one cell of many blocks, all."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((100, 8)) + 6 * rng.standard_normal(8) for _ in range(8)])
    points = spark.createDataFrame([((0,), i, v.tolist()) for i, v in enumerate(x)], "cohort struct<a:int>, id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    true = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i])[:10]}
    got = {(r["id"], r["near"]) for r in DT.neighbours(points, 10, 8, cell_rows=100).collect()}
    assert len(got & true) / len(true) > 0.9
    one = DT.neighbours(points.withColumn("v", F.col("v")), 10, 8, cell_rows=10_000)
    assert {(r["id"], r["near"]) for r in one.collect()} == true


def test_copies_few_rows_and_nulls(spark):
    rows = [(i, [0.0, 0.0]) for i in range(40)] + [(100 + i, [5.0 + i % 5, 5.0 + i // 5]) for i in range(25)] + [(200, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    topics, centroids = DT.density_topics(df, "id", "v", min_size=5)
    got = {r["id"]: r["topic"] for r in topics.collect()}
    assert 200 not in got and len(got) == 65 and len({got[i] for i in range(40)}) == 1
    few = spark.createDataFrame(rows[38:42], "id int, v array<double>")
    assert {r["topic"] for r in DT.density_topics(few, "id", "v")[0].collect()} == {-1}
