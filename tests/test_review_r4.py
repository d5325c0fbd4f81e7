"""Tests for the findings of review round 4."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wreath.operators import linkage as LK
from wreath.operators import relational as R
from wreath.operators import similarity as SM
from wreath.operators import topics as TP
from wreath.operators import vectors as VO


def _comparisons():
    return [LK.Comparison("title_level", "t_l", "t_r"), LK.Comparison("author_level", "a_l", "a_r")]


def test_em_goes_on_until_nothing_moves():
    """One match in a hundred thousand pairs takes more than a thousand rounds."""
    hist = [((0, 0), 5713021), ((0, 1), 1949240), ((0, 2), 113244), ((0, 3), 15), ((1, 0), 1299681), ((1, 1), 455752), ((1, 2), 25903), ((1, 3), 4),
            ((2, 0), 74609), ((2, 1), 30289), ((2, 2), 1825), ((2, 3), 97), ((3, 0), 73437), ((3, 1), 28984), ((3, 2), 1800), ((3, 3), 99)]
    u = {"title_level": [0.79717, 0.182745, 0.010315, 0.00977], "author_level": [0.738095, 0.24758, 0.01432, 0.000005]}
    m, share = LK.em_histogram(hist, _comparisons(), u)
    again, same = LK.em_histogram(hist, _comparisons(), u, tol=1e-7)
    assert abs(share - same) < 1e-3 and all(np.abs(m[k] - again[k]).max() < 1e-2 for k in m)
    model = LK.LinkageModel(_comparisons(), m, u, share)
    weight = {(name, level): bf for name, level, bf in model.weight_rows()}
    odds = np.log2(share / (1 - share))
    assert all(1 / (1 + 2 ** -(odds + weight["title_level", t] + weight["author_level", 3])) >= 0.9 for t in (2, 3))


def test_table_of_similarities():
    rng = random.Random(2)
    for most, letters in ((7, "ab"), (24, "abcde "), (40, "abcdefgh é漢😀"), (80, "abcdefghijkl")):
        a, b = (["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)] for n in (40, 30))
        assert np.array_equal(LK.jaro_winkler_table(a, b), [[LK.jaro_winkler(x, y) for y in b] for x in a])


def test_small_tiles_are_compared_together():
    rng = random.Random(3)
    names = [None, "", *["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(12)]]

    def tile(side, first):
        rows = [{f"__{side}0": rng.choice(names), f"__{side}1": rng.choice(names), "__id": first + k, "__w": 1.0} for k in range(rng.randint(1, 5))]
        return pa.array(rows, pa.struct([(f"__{side}0", pa.string()), (f"__{side}1", pa.string()), ("__id", pa.int64()), ("__w", pa.float64())]))

    tiles, sizes = [(tile("left", 100 * n), tile("right", 100 * n)) for n in range(30)], []

    def found(code, at, a, b):
        i, j = at(np.arange(code.size))
        sizes.append(code.ndim)
        return [(a[int(x)]["__id"].as_py(), b[int(y)]["__id"].as_py(), int(c)) for x, y, c in zip(i, j, code.ravel())]

    together = [x for out in SM._compare(iter(tiles), _comparisons(), found) for x in out]
    assert sizes == [1]
    alone = [x for out in SM._compare(iter(tiles), _comparisons(), found, few_pairs=0) for x in out]
    assert together == alone and sizes[1:] == [2] * len(tiles)


def test_leveled_pairs_leave_python_in_pieces(spark):
    """Python hands over one number a pair; ids are told once a piece of pairs. A piece has at most PIECE rows a side."""
    keys = [(n, n % 3, ["apple", "apples", "pear", None, ""][n % 5], ["ann lee", "ann li", "bo"][n % 3]) for n in range(700)]
    l = spark.createDataFrame(keys[:300], "id_l int, y_l int, t_l string, a_l string")
    r = spark.createDataFrame(keys[300:], "id_r long, y_r int, t_r string, a_r string")
    comps = _comparisons()
    got = SM.leveled_pairs(l.withColumnRenamed("id_l", "id"), r.withColumnRenamed("id_r", "id"), ("y_l", "y_r"), comps, ("id", "id"))
    assert "__codes" in [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "MapInArrow" in line][0]
    want = LK.add_levels(l.join(r, l.y_l == r.y_r), comps).select("id_l", "id_r", "title_level", "author_level")
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    assert got.count() == 3 * 100 * 400 // 3


def test_match_probability_is_looked_up(spark):
    """Weight and probability are constants of a pattern: no power and no rounding is left for the rows."""
    model = LK.LinkageModel(_comparisons(), {"title_level": [0.01, 0.02, 0.07, 0.9], "author_level": [0, 0.05, 0.15, 0.8]},
                            {"title_level": [0.95, 0.0485, 0.001, 0.0005], "author_level": [0.7, 0, 0.3, 0]}, 0.001)
    levels = [None, -1, 0, 1, 2, 3, 7]
    df = spark.createDataFrame([(t, a) for t in levels for a in levels], "title_level int, author_level int")
    got = LK.match_probability(df, model, digits=6)
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "pow" not in plan and "round" not in plan
    weight = {(name, level): bf for name, level, bf in model.weight_rows()}
    for row in got.collect():
        w = np.log2(0.001 / 0.999) + weight.get(("title_level", row.title_level), 0) + weight.get(("author_level", row.author_level), 0)
        assert abs(row.match_weight - w) < 1e-6 and abs(row.match_probability - 1 / (1 + 2 ** -w)) < 1e-6


def test_topic_steps_read_blocks(spark, monkeypatch):
    """A step of k-means reads blocks of numbers and returns a sum a task: no plan with an aggregate for each dimension."""
    def refuse(*_, **__):
        raise AssertionError("a step planned an aggregate")

    monkeypatch.setattr(VO, "mean_vector", refuse)
    rng = np.random.default_rng(8)
    vectors = [rng.standard_normal(3).tolist() for _ in range(5_000)]
    rows = [(n, [2000, 2001, 2002, None][n % 4], v) for n, v in enumerate(vectors)] + [(90_000 + n, 2000, [None, 1.0, 2.0]) for n in range(3)]
    rows.append((99_999, 2003, [1.0, 2.0, 3.0]))
    df = spark.createDataFrame(rows, "id long, year int, v array<double>")
    monkeypatch.setattr(TP, "SUMS_BYTES", 0)             # sums of the tasks added up by tasks
    assigned, cents = TP.fit_topics(df, "id", "v", by=["year"], k=3, seed=1)
    assert assigned.count() == sum(r[1] is not None for r in rows)
    topic_of = {r.id: r.topic for r in assigned.collect()}
    assert all(topic_of[90_000 + n] == 0 for n in range(3)) and topic_of[99_999] == 0
    for year in (2000, 2001):
        found = {r.topic: np.array(r.centroid) for r in cents.where(F.col("year") == year).collect()}
        members = {t: [r[2] for r in rows if r[1] == year and topic_of[r[0]] == t] for t in found}
        for t, c in found.items():
            means = [np.mean([v[i] for v in members[t] if v[i] is not None]) for i in range(3)]
            assert np.allclose(c, means, atol=1e-3)
        near = {n: min(found, key=lambda t: (np.sum((np.array(v) - found[t]) ** 2), t)) for n, y, v in rows if y == year and None not in v}
        assert all(topic_of[n] == t for n, t in near.items())


def test_blocked_pairs_by_even_slices(spark, monkeypatch):
    """Right rows of a block meet the left ones in slices of a fixed size, whatever the block's size; keys may repeat or be null."""
    monkeypatch.setattr(R, "SLICE_ROWS", 8)
    left = [(n // 2, [1, 2, None][n % 3]) for n in range(40)]
    right = [(n // 3, [1, 1, 2, None, 9][n % 5]) for n in range(95)] + [(500, 1)] * 20
    l, r = spark.createDataFrame(left, "id long, y int"), spark.createDataFrame(right, "id long, y int")
    pairs = R.blocked_pairs(l, r, F.col("y"), F.col("y"))
    assert pairs.columns == ["id_l", "y_l", "id_r", "y_r"]
    want = sorted((a, y, b, z) for a, y in left for b, z in right if y is not None and y == z)
    assert sorted(map(tuple, pairs.collect())) == want
    sizes = {}
    for at, row in pairs.withColumn("at", F.spark_partition_id()).where("y_l = 1").select("at", "id_l").collect():
        sizes[row] = sizes.get(row, 0) + 1
    n = sum(z == 1 for _, z in right)
    assert all(size % n == 0 for size in sizes.values())
    cells = R.blocked_pairs(l.distinct(), r, F.col("y"), F.col("y")).where("y_l = 1").groupBy(F.spark_partition_id(), "id_l").count().collect()
    assert len(cells) > len({c.id_l for c in cells})                # the slices of one left row come from several tasks


def test_no_matches_among_the_pairs(spark):
    """A share of matches next to nothing, or nothing, is no error: no pattern reaches the threshold."""
    for prior in (1e-310, 0.0):
        model = LK.LinkageModel(_comparisons(), {c.name: [0.1, 0.2, 0.3, 0.4] for c in _comparisons()}, {c.name: [0.7, 0.2, 0.05, 0.05] for c in _comparisons()}, prior)
        assert SM.requirements(model, 0.9) == []
        df = spark.createDataFrame([(3, 3), (0, -1)], "title_level int, author_level int")
        assert [r.match_probability < 1e-300 for r in LK.match_probability(df, model).collect()] == [True, True]
