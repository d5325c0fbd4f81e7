import pytest

from wreath.functions.aggregates import (
    concat_distinct_by,
    first_nonnull_by,
    last_nonnull_by,
    list_keep_nulls,
    ordered_list,
)
from wreath.operators import relational as R
from wreath.operators import stats as ST
from wreath.operators import triples as TR


def test_concat_distinct_first_seen_order(spark):
    df = spark.createDataFrame([(1, "b", 3), (1, "a", 1), (1, "b", 0), (1, "c", 2), (2, "x", 5)],
                               "k int, name string, pos int")
    got = {r.k: r.name for r in concat_distinct_by(df, "k", "name", "pos").collect()}
    assert got == {1: "b a c", 2: "x"}


def test_first_last_nonnull_and_lists(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "p", 2), (1, "q", 3), (1, None, 4)],
                               "k int, v string, pos int")
    r = df.groupBy("k").agg(first_nonnull_by("v", "pos").alias("f"), last_nonnull_by("v", "pos").alias("l"),
                            ordered_list("v", "pos").alias("o"), list_keep_nulls("v").alias("n")).first()
    assert (r.f, r.l, r.o) == ("p", "q", [None, "p", "q", None]) and sorted(r.n, key=str) == sorted(
        [None, "p", "q", None], key=str)


def test_coverage_report(spark):
    works = spark.createDataFrame([(1,), (2,), (3,), (3,)], "k int")
    s1 = spark.createDataFrame([(1,), (9,)], "k int")
    s2 = spark.createDataFrame([(1,), (3,)], "k int")
    r = ST.coverage_report(works, "k", [s1, s2]).first()
    assert (r.n_works, r.n_covered, r.n_missing) == (3, 2, 1)


def test_five_number_and_histogram(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 6)], "g int, x double")
    r = ST.five_number(df, "g", "x").first()
    assert (r.q0, r.q1, r.q2, r.q3, r.q4) == (1.0, 2.0, 3.0, 4.0, 5.0)
    h = {row.bin_lo: row.n for row in ST.histogram(df, "x", 2.0).collect()}
    assert h == {0.0: 1, 2.0: 2, 4.0: 2}


def test_graph_pattern_guards(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c")], "subject string, property string, object string")
    with pytest.raises(ValueError):
        TR.match_pattern(t, [("?x", "p", "?y"), ("?z", "q", "?w")])  # no shared variable
    assert [tuple(r) for r in TR.path(t, "?s", ["p", "q"], "?o").collect()] == [("a", "c")]


def test_asof_several_values(spark):
    left = spark.createDataFrame([(1, 2000)], "a int, y int")
    right = spark.createDataFrame([(1, 1990, 5, "old"), (1, 1999, 7, "new")], "a int, y int, v int, w string")
    for method in ("join", "scan"):
        r = R.asof_join(left, right, "a", "y", "y", ["v", "w"], method=method).first()
        assert (r.v, r.w) == (7, "new")
