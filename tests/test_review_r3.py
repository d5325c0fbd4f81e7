"""Tests for the findings of review round 3."""

import numpy as np
import pyarrow as pa
from pyspark.util import PythonEvalType

from wreath.functions import text as TX
from wreath.llm import kneser_ney as KN, pairwise_quality as QU, textbytes as TB
from wreath.operators import relational as R
from wreath.plans import stages as S
from wreath.plans.queries_surface import _mode_smallest


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clustered_dedup_moves_rows_once_and_splits_hot_bins(spark, monkeypatch):
    rows = [(w, a, aw, y, k) for k, (w, a, aw, y) in enumerate(
        [(1, 1, "x", 5), (1, 1, "x", 4), (1, 1, "y", None), (1, 1, "y", 9), (2, None, "x", 3), (2, None, "x", 2), (None, 7, None, 1), (None, 7, None, None)] * 3)]
    df = spark.createDataFrame(rows, "w long, a long, aw string, y int, k long")
    want = {(1, 1, "x", 4), (1, 1, "y", 9), (2, None, "x", 2), (None, 7, None, 1)}
    for hot in (100_000, 3, 0):
        monkeypatch.setattr(R, "HOT_ROWS", hot)
        got = R.dedup_first(df, ["w", "a", "aw"], ["y", "k"], cluster_by=["w", "a"])
        assert got.columns == df.columns
        found = [tuple(r)[:4] for r in got.collect()]
        assert set(found) == want and len(found) == len(want)


def test_asof_history_moves_left_rows_once(spark):
    left = spark.createDataFrame([(1, 5, "p"), (1, 3, "q"), (1, None, "r"), (None, 9, "s"), (2, 9, "t"), (3, 1, "u")], "a long, y int, n string")
    right = spark.createDataFrame([(1, 3, 10), (1, 4, 20), (1, 5, 30), (1, None, 99), (2, 9, 7), (None, 1, 8)], "a long, t int, v long")
    for strict, want in ((True, {"p": 20, "q": -1, "r": -1, "s": -1, "t": -1, "u": -1}), (False, {"p": 30, "q": 10, "r": -1, "s": -1, "t": 7, "u": -1})):
        got = R.asof_join(left, right, "a", "y", "t", "v", strict=strict, default=-1, method="history")
        assert {r.n: r.v for r in got.collect()} == want and got.columns == ["a", "y", "n", "v"]


def test_work_profiles_make_their_rows_once(spark, tmp_path):
    rows = [(1, "t", 7, 1, 30, "f", "A", 2), (1, "t", 3, None, None, None, None, 0), (1, "u", 3, 2, 40, "m", "B", 1), (None, "z", 1, 1, 1, "f", "A", 1)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "work_id long, title string, author_id long, n_win long, age int, gender string, birth_country string, "
                                "awards_as_of_year int").write.parquet(path)
    got = S.work_profiles(spark.read.parquet(path))
    assert _plan(got).count("FileScan parquet") == 1
    r, = got.collect()
    assert (r.work_id, r.title, r.author_id, r.n_win, r.mean_age, r.awards_as_of_year) == (1, "t", 3, None, 35.0, 3)
    assert (r.gender, r.birth_country) == (["m", None, "f"], ["B", None, "A"])


def test_clean_nominations_partitioned_by_work(spark):
    nom = spark.createDataFrame([(1, 1, "T", "A", "x", "winner", 1990, "d1", 0, 0), (1, 1, "T", "A", "y", "nominated", 1992, "d2", 1, 0),
                                 (1, 2, "T", "B", "x", "winner", 1991, None, 2, 0), (2, None, "U", None, "x", "winner", 1991, None, 3, 0)],
                                "work_id long, author_id long, title string, author_label string, award string, status string, year int, "
                                "pub_date string, ok long, ln int").selectExpr("*", "'' openlibrary_id", "'' isbn", "'' article")
    awards = spark.createDataFrame([(1, "A", "x", 1990), (1, "A", "y", 1992), (2, "B", "x", 1991)], "author_id long, author_label string, award string, year int")
    bio = spark.createDataFrame([(1, "1950-01-01T00:00:00Z", "N", "f"), (1, "1960-01-01T00:00:00Z", "N", "f")],
                                "author_id long, dob string, birth_country string, gender string")
    plain = S.clean_nominations(nom, awards, bio)
    by_work = S.clean_nominations(nom, awards, bio, cluster_by=["work_id"])
    seen = lambda df: sorted((r.work_id, r.author_id or 0, r.year, r.awards_as_of_year, r.age or 0, r.n_win) for r in df.collect())
    want = [(1, 1, y, 1, age, w) for y, w in ((1990, 1), (1992, 0)) for age in (30, 32, 40, 42)] + [(1, 2, 1991, 0, 0, 1), (2, 0, 1991, 0, 0, 1)]
    assert seen(plain) == seen(by_work) == sorted(want)
    assert _plan(by_work).count("hashpartitioning(work_id#") >= 2


def test_text_is_spelt_in_slices(spark):
    texts = pa.array(["", None, "Straße" * 3, "x" * 50, None, "Ä", "é" * 20])
    parts = list(TX.slices(texts, 40))
    assert pa.concat_arrays(parts).equals(texts)
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= 40 for p in parts) and len(parts) > 2
    assert list(TX.slices(pa.array([], pa.string()))) == []
    # a sliced array: its offsets do not begin at 0
    assert pa.concat_arrays(list(TX.slices(texts.slice(2, 4), 40))).equals(texts.slice(2, 4))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "i int, t string")
    got = [r.a for r in df.select("i", TX.fold_ascii("t").alias("a")).orderBy("i").collect()]
    assert got == ["", None, "strasse" * 3, "x" * 50, None, "a", "e" * 20]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_grouped_mode_takes_arrow_arrays(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 4, 2), (1, 3, 1), (None, 9, 1), (None, 8, 1)], "w int, y long, n long")
    got = df.groupBy("w").agg(_mode_smallest("y", "n").alias("m"))
    assert {r.w: r.m for r in got.collect()} == {1: 4, None: 8}
    assert _mode_smallest.evalType == PythonEvalType.SQL_GROUPED_AGG_ARROW_UDF


def test_learned_models_give_memory_back_after_a_batch(spark, monkeypatch):
    given = []
    monkeypatch.setattr(TB, "give_back", lambda: given.append(1))
    texts = pa.array(["one Two two", None, "", "three"])
    assert len(QU.feature_udf().func(texts)) == 4 and len(given) == 1
    assert len(KN._word_counter().func(texts)) == 4 and len(given) == 2


def test_powers_do_not_stay_with_an_idle_worker():
    data = np.frombuffer(b"ab " * 100_000, np.uint8)
    one = lambda: TB.span_hashes(data, np.array([0, 3]), np.array([2, 200_000]))
    before = one()
    assert len(TB._POWERS["up"]) > 100_000
    TB.give_back()
    assert len(TB._POWERS["up"]) == len(TB._POWERS["down"]) == 1
    assert np.array_equal(one(), before)


def test_merged_rows_are_not_stored(spark, monkeypatch):
    """The merged table has a row for each list year of each linked title: it is stored nowhere before the split."""
    from wreath.plans import queries_cohort as Q

    stored = []
    monkeypatch.setattr(Q, "materialize", lambda df, keep=Q.materialize: stored.append(set(df.columns)) or keep(df))
    out = Q.g4_merge_and_split(spark, "/root/testdata/sf0.001")
    assert {"split", "pub_date", "topicality", "median"} <= set(out.columns)
    assert stored and not [c for c in stored if {"pub_date", "median"} <= c]


def test_only_titles_with_ranks_are_linked(spark, monkeypatch):
    from wreath.plans.queries_linkage import FIXED_MODEL

    linked = []
    monkeypatch.setattr(S, "linked_pairs", lambda lists, *a, link=S.linked_pairs: linked.append(lists.count()) or link(lists, *a))
    lists = spark.createDataFrame([(i, "the title", "an author", 1) for i in (1, 3, 5, None)], "unique_id long, title string, author string, year int")
    works = spark.createDataFrame([(i, "the title", "an author", 2) for i in (2, 4, 2)], "unique_id long, title string, author string, year int")
    ranks = spark.createDataFrame([(3, 1, 7), (3, 1, 9), (3, 2, 1), (3, None, 4), (9, 1, 1), (None, 1, 1)], "title_id long, year int, rank long")
    got = S.bestseller_match(lists, works, ranks, FIXED_MODEL)
    assert sorted(tuple(r) for r in got.collect()) == [(2, 9, 2, 8.0), (4, 9, 2, 8.0)] and linked == [1]
