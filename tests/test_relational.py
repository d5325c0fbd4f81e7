from pyspark.sql import functions as F

from wreath.operators import relational as R


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_dedup_first_ties_and_nulls_last(spark):
    df = spark.createDataFrame(
        [("a", None, 1), ("a", "2000", 2), ("a", "2000", 0), ("b", None, 5), ("b", None, 3)],
        "k string, d string, id int")
    for buckets in (1, 16):
        out = R.dedup_first(df, "k", ["d", "id"], buckets=buckets)
        assert rows(out, "k", "d", "id") == [("a", "2000", 0), ("b", None, 3)]


def test_dedup_first_hot_key_matches_brute_force(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 1009).alias("v"), "id")
    out = R.dedup_first(df, "k", ["v", "id"], buckets=8)
    pdf = df.toPandas().sort_values(["v", "id"]).groupby("k").head(1)
    assert rows(out, "k", "v", "id") == sorted(map(tuple, pdf[["k", "v", "id"]].values.tolist()))


def test_asof_strict_no_lookahead_and_default(spark):
    left = spark.createDataFrame([(1, 2000), (1, 2002), (2, 2001), (3, 1999)], "a int, y int")
    right = spark.createDataFrame([(1, 1999, 5), (1, 2000, 7), (1, 2002, 9), (2, 2001, 4)], "a int, y int, v int")
    for method in ("join", "scan"):
        out = R.asof_join(left, right, "a", "y", "y", "v", strict=True, default=0, method=method)
        # same-year rows are never visible (strict); one-year-only authors get 0
        assert rows(out, "a", "y", "v") == [(1, 2000, 5), (1, 2002, 7), (2, 2001, 0), (3, 1999, 0)]


def test_asof_non_strict(spark):
    left = spark.createDataFrame([(1, 2000)], "a int, y int")
    right = spark.createDataFrame([(1, 2000, 7), (1, 1990, 1)], "a int, y int, v int")
    for method in ("join", "scan"):
        out = R.asof_join(left, right, "a", "y", "y", "v", strict=False, method=method)
        assert rows(out, "a", "y", "v") == [(1, 2000, 7)]


def test_fill_join_primary_wins(spark):
    p = spark.createDataFrame([(1, "p1"), (2, None)], "k int, v string")
    f = spark.createDataFrame([(2, "f2"), (3, "f3"), (1, "f1")], "k int, v string")
    assert rows(R.fill_join(p, f, "k"), "k", "v") == [(1, "p1"), (2, "f2"), (3, "f3")]


def test_first_tier_never_overwrites_and_skips_empty(spark):
    t1 = spark.createDataFrame([(1, 0, ""), (2, 0, None)], "k int, pos long, v string")
    t2 = spark.createDataFrame([(1, 5, "later"), (2, 9, ""), (2, 3, "two")], "k int, pos long, v string")
    out = R.first_tier([t1, t2], "k", "v", pos="pos", nonempty=[False, True])
    # tier 1 accepts an empty text (it only drops nulls); tier 2 skips empties
    assert rows(out, "k", "tier", "v") == [(1, 0, ""), (2, 1, "two")]


def test_densify_fills_zero(spark):
    df = spark.createDataFrame([("t", 3, 4)], "topic string, month int, n long")
    out = R.densify(df, ["topic"], "month", 1, 12, "n")
    got = {r["month"]: r["n"] for r in out.collect()}
    assert len(got) == 12 and got[3] == 4 and sum(got.values()) == 4


def test_explode_zip_empty_and_null(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [1, 2]), (2, [], []), (3, None, None)],
                               "id int, s array<string>, n array<int>")
    out = R.explode_zip(df, ["s", "n"])
    assert rows(out, "id", "s", "n") == [(1, "a", 1), (1, "b", 2), (2, None, None), (3, None, None)]


def test_group_all_but_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "k string, v int")
    out = R.group_all_but(df, ["v"], [F.sum("v").alias("s")])
    assert sorted(out.collect(), key=lambda r: str(r["k"])) == sorted(
        [(None, 3), ("x", 3)], key=lambda r: str(r[0]))


def test_top_n_matches_brute_force(spark):
    df = spark.range(3000).select((F.col("id") % 4).alias("g"), ((F.col("id") * 37) % 101).alias("s"), "id")
    out = R.top_n(df, "g", "s", "id", 7, buckets=5)
    pdf = df.toPandas().sort_values(["s", "id"]).groupby("g").head(7)
    assert rows(out, "g", "s", "id") == sorted(map(tuple, pdf[["g", "s", "id"]].values.tolist()))


def test_temporal_split_disjoint(spark):
    df = spark.range(1950, 2030).select(F.col("id").cast("int").alias("year"))
    tr, te = R.temporal_split(df, "year", (1959, 2019), (2019, 2025))
    a, b = {r.year for r in tr.collect()}, {r.year for r in te.collect()}
    assert not (a & b) and min(a) == 1959 and max(a) == 2018 and min(b) == 2019 and max(b) == 2024


def test_running_total_includes_peers(spark):
    df = spark.createDataFrame([(1, 2000, 1), (1, 2000, 2), (1, 2001, 3)], "a int, y int, v int")
    out = R.running_total(df, "a", "y", "v")
    assert rows(out, "y", "running_total") == [(2000, 3), (2000, 3), (2001, 6)]
