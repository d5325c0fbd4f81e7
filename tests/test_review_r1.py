"""Shapes that the test tables never hold: several rows per pair, scores far apart,
list titles with many rows, awkward CSV text, patterns in any order."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wreath import session as SE
from wreath.functions import text as TX
from wreath.operators import cohort as C
from wreath.operators import linkage as LK
from wreath.operators import topics as TP
from wreath.operators import triples as TR
from wreath.plans import stages as S
from wreath.sources import io as IO


def test_clean_nominations_with_two_rows_per_pair(spark):
    nom = spark.createDataFrame(
        [(10, 7, "A", "winner", 1990, "1990-01-01T00:00:00Z", 1, 1), (10, 7, "B", "nominated", 2000, "1995-01-01T00:00:00Z", 2, 1)],
        "work_id int, author_id int, award string, status string, year int, pub_date string, ok int, ln int").select(
        "*", F.lit(None).cast("string").alias("openlibrary_id"), F.lit(None).cast("string").alias("isbn"), F.lit(None).cast("string").alias("article"))
    awards = spark.createDataFrame([(7, "x", "A", 1985), (7, "x", "B", 1995)], "author_id int, author_label string, award string, year int")
    bio = spark.createDataFrame([(7, "1950-01-01T00:00:00Z", "DE", "female")], "author_id int, dob string, birth_country string, gender string")
    got = sorted((r.year, r.awards_as_of_year, r.age) for r in S.clean_nominations(nom, awards, bio).collect())
    assert got == [(1990, 2, 40), (1990, 2, 50), (2000, 2, 40), (2000, 2, 50)]
    once = sorted((r.year, r.awards_as_of_year, r.age) for r in S.clean_nominations(nom, awards, bio, dedup_keys=True).collect())
    assert once == [(1990, 2, 40), (2000, 2, 40)]


def test_loss_with_scores_far_apart(spark):
    df = spark.createDataFrame([(1, 0.0, 1), (1, 1000.0, 1)], "c int, score double, n int")
    p = C.cohort_softmax(df, "c", "score", log_out="ln_p")
    assert C.multinomial_ce_loss(p, "c", "n", "p_win", log_p="ln_p").first().loss == 500.0
    assert C.multinomial_ce_loss(p, "c", "n", "p_win").first().loss == math.inf


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_list_titles_with_many_rows(spark, parts):
    lists = spark.createDataFrame([(1, "The Title", "An Author", y, i) for i, y in enumerate([1975, 1970, 1980] * 5)],
                                  "unique_id int, title string, author string, year int, line int").repartition(parts)
    works = spark.createDataFrame([(5, "The Title", "An Author", 1971), (6, "The Title", "An Author", 1976)],
                                  "unique_id int, title string, author string, year int")
    ranks = spark.createDataFrame([(1, 1960, 3), (1, 1960, 5)], "title_id int, year int, rank int")
    exact = {c: np.array([0.9, 0.05, 0.03, 0.02]) for c in ("title_level", "author_level")}
    comps = [LK.Comparison("title_level", "title_key_l", "title_key_r"), LK.Comparison("author_level", "author_key_l", "author_key_r")]
    m = {c.name: np.r_[np.full(c.n_levels - 1, 0.01), 1 - 0.01 * (c.n_levels - 1)] for c in comps}
    u = {c.name: m[c.name][::-1] for c in comps}
    del exact
    model = LK.LinkageModel(comps, m, u, 0.5)
    assert [r.work_id for r in S.bestseller_match(lists, works, ranks, model).collect()] == [5]
    assert [r.work_id for r in S.bestseller_match(lists, works, ranks, model, list_order=["line"]).collect()] == [6]


@pytest.mark.parametrize("fmt", ["csv", "tsv"])
def test_awkward_text_comes_back(spark, tmp_path, fmt):
    texts = ["  lead and trail  ", "\nnl first", "nl last\n", "", None, 'a "quoted", one', "tab\tin", "back\\slash", "two\n\nlines", "''"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    IO.write_table(df, str(tmp_path / fmt), fmt)
    back = IO.read_table(spark, str(tmp_path / fmt), fmt, "i int, t string").orderBy("i").collect()
    assert [r.t for r in back] == texts


def test_patterns_in_any_order(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("c", "q", "d"), ("b", "r", "c"), ("x", "p", "x")], "subject string, property string, object string")
    got = TR.match_pattern(t, [("?a", "p", "?b"), ("?c", "q", "?d"), ("?b", "r", "?c")]).collect()
    assert [(r.a, r.b, r.c, r.d) for r in got] == [("a", "b", "c", "d")]
    assert [r.s for r in TR.match_pattern(t, [("?s", "p", "?s")]).collect()] == ["x"]


def test_pairs_do_not_depend_on_partitions(spark):
    left = spark.range(3000).select(F.col("id").alias("x"))
    right = spark.range(2000).select((F.col("id") * 3).alias("x"))
    sums = {tuple(LK.random_pairs(left.repartition(n), right.repartition(n), 20_000, 5).agg(F.sum("x_l"), F.sum("x_r"), F.count("*")).first()) for n in (2, 5)}
    assert len(sums) == 1


def test_adf_p_values_of_published_critical_points():
    for tau, p in ((-4.37113, 0.01), (-3.83239, 0.05), (-3.55326, 0.10)):
        assert abs(TP.adf_pvalue(tau) - p) < 0.002
    assert TP.adf_pvalue(-20) == 0 and TP.adf_pvalue(1) == 1 and math.isnan(TP.adf_pvalue(float("nan")))


def test_stationarity_drops_constant_series(spark):
    rows = [("flat", m, 7) for m in range(1, 13)] + [("wave", m, m % 5 + (m == 3) * 9) for m in range(1, 13)]
    freq = spark.createDataFrame(rows, "topic string, month int, frequency long")
    assert [r.topic for r in TP.stationary(0.1, 3)(freq, ["topic"]).collect()] == ["wave"]


def test_stray_percent_in_article_names(spark):
    df = spark.createDataFrame([("100%_Wolf",), ("A%20B%zz",), ("C%3A_D+E",)], "u string")
    assert [r[0] for r in df.select(TX.article_name(F.col("u"))).collect()] == ["100%_Wolf", "A B%zz", "C:_D+E"]


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        SE.ensure_checkpoint_dir(Session())


def text_of(spark, fn, value):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


def test_folding_beyond_latin_1(spark):
    for text in ("ﬃ µ Straße ẞ ŉ", "ΑΣΣ Ωραίο", "ꭰ ĐÈ"):
        assert text_of(spark, TX.casefold, text) == text.casefold()
    for text, want in (("Nguyễn", "nguyen"), ("Ștefan", "stefan"), ("Чехов", "chekhov"), ("Достоевский", "dostoevskii"),
                       ("Σωκράτης", "sokrates"), ("ﬃ Œuvre Łódź", "ffi oeuvre lodz")):
        assert text_of(spark, lambda c: TX.to_ascii(TX.casefold(c)), text) == want


def test_paragraphs_of_awkward_html(spark):
    for page, want in (
            ("<P>it&#8217;s caf&eacute; &#x5B;1&#93; &unknown; &amp;lt; &#128512;</P>", "it’s café [1] &unknown; &lt; 😀"),
            ("<p>a<span class='big error'>x<span>y</span> tail</span>b</p>", "ab"),
            ('<p>a<span class="terrors">kept</span></p>', "akept"),
            ("<p>one<p class='x'>two</p><pre>no</pre>", "one\ntwo")):
        assert text_of(spark, TX.paragraph_text, page) == want


def test_synopsis_of_any_heading_level(spark):
    prefixes = ["plot", "synopsis"]
    page = ("<p>intro</p><h2>Book</h2><p>about</p><h3 id='p'>Plot &amp; themes</h3><p>first</p><h4>Part 2</h4><p>second</p>"
            "<h3>Reception</h3><p>well</p>")
    assert text_of(spark, lambda c: TX.synopsis(c, prefixes), page) == "first\nsecond"
    assert text_of(spark, lambda c: TX.synopsis(c, prefixes), "<p>intro</p><h2>Other</h2><p>x</p>") == "intro"
    assert text_of(spark, lambda c: TX.synopsis(c, prefixes), "<p>intro</p><h2>Plot</h2><h2>B</h2><p>x</p>") is None
