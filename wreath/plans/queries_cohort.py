"""Tiered descriptions, entity-fact patterns, count encoding, cohort
metrics (baseline, loss, KPIs, ranker) and feature relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from wreath.operators import cohort as C
from wreath.operators import relational as R
from wreath.operators import stats as ST
from wreath.operators import triples as TR
from wreath.operators.encode import CountEncoder
from wreath.plans import stages as S
from wreath.plans.fixtures import Fixtures
from wreath.plans.queries_nomination import FEATURES, _clean, _stats
from wreath.plans.registry import query
from wreath.session import materialize


# ---------------------------------------------------------------- J27
@query("j27_tiered_descriptions", oracle="""
WITH u AS (
  SELECT work_id, 0 AS tier, pos, description FROM tier1 WHERE description IS NOT NULL
  UNION ALL SELECT work_id, 1, pos, description FROM tier2 WHERE description IS NOT NULL AND length(description) > 0
  UNION ALL SELECT work_id, 2, pos, description FROM tier3 WHERE description IS NOT NULL AND length(description) > 0
  UNION ALL SELECT work_id, 3, pos, description FROM tier4 WHERE description IS NOT NULL AND length(description) > 0),
first_ AS (SELECT work_id, description FROM u QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY tier, pos) = 1),
man AS (SELECT work_id, description FROM manual WHERE description IS NOT NULL)
SELECT coalesce(f.work_id, m.work_id) AS work_id, coalesce(f.description, m.description) AS description
FROM first_ f FULL JOIN man m ON f.work_id = m.work_id
""")
def j27_tiered_descriptions(spark, sf):
    """Descriptions from four tiers in priority order, manual ones fill the rest."""
    fx = Fixtures(spark, sf)
    return S.tiered_descriptions([fx.tier1, fx.tier2, fx.tier3, fx.tier4], fx.manual)


# ---------------------------------------------------------------- C12..C15, G2, D24, I23
@query("c13_basic_graph_pattern", oracle="""
SELECT a.subject AS s, n.object AS name, r2.object AS region_name
FROM triples a JOIN triples b ON b.subject = a.object AND b.property = 'region'
JOIN triples r2 ON r2.subject = b.object AND r2.property = 'name'
JOIN triples n ON n.subject = a.subject AND n.property = 'name'
WHERE a.property = 'nation'
""")
def c13_basic_graph_pattern(spark, sf):
    """Conjunctive pattern: entity -> nation -> region -> region name, plus entity name."""
    t = Fixtures(spark, sf).triples
    out = TR.match_pattern(t, [("?s", "nation", "?n"), ("?n", "region", "?r"), ("?r", "name", "?region_name"),
                               ("?s", "name", "?name")])
    return out.select("s", "name", "region_name")


@query("c13_statement_qualifiers", oracle="""
WITH v(p, status) AS (VALUES ('award_received', 'winner'), ('nominated_for', 'nominated'))
SELECT DISTINCT a.subject AS s, aw.object AS award, TRY_CAST(y.object AS INT) AS year, v.status
FROM triples a
JOIN v ON a.property = v.p
JOIN triples aw ON aw.subject = a.object AND aw.property = 'award'
JOIN triples y ON y.subject = a.object AND y.property = 'point_in_time'
WHERE TRY_CAST(y.object AS INT) >= 1998
""")
def c13_statement_qualifiers(spark, sf):
    """Statement nodes with qualifiers: ?s ?p ?st . ?st award ?a .
    ?st point_in_time ?y, with (p, status) from an inline VALUES table and a
    filter on the qualifier; DISTINCT rows as in the reference queries."""
    t = Fixtures(spark, sf).triples
    vals = TR.values_table(spark, ["p", "status"], [("award_received", "winner"), ("nominated_for", "nominated")])
    m = TR.match_pattern(t, [("?s", "?p", "?st"), ("?st", "award", "?award"), ("?st", "point_in_time", "?y")],
                         values=vals)
    return (m.select("s", "award", F.col("y").try_cast("int").alias("year"), "status")
            .filter(F.col("year") >= 1998).distinct())


@query("c14_path_sequence", oracle="""
SELECT a.subject AS s, b.object AS r FROM triples a JOIN triples b ON b.subject = a.object
WHERE a.property = 'nation' AND b.property = 'region'
""")
def c14_path_sequence(spark, sf):
    """Two-hop property path nation/region."""
    return TR.path(Fixtures(spark, sf).triples, "?s", ["nation", "region"], "?r")


@query("c12_optional_match", oracle="""
SELECT n.subject AS s, n.object AS name, g.object AS segment
FROM triples n LEFT JOIN triples g ON g.subject = n.subject AND g.property = 'segment'
WHERE n.property = 'name'
""")
def c12_optional_match(spark, sf):
    """Every named entity with its segment when it has one (OPTIONAL -> left join)."""
    t = Fixtures(spark, sf).triples
    return TR.match_pattern(t, [("?s", "name", "?name")], optional=[[("?s", "segment", "?segment")]])


@query("c15_values_join", oracle="""
SELECT t.subject AS s, t.object AS award, v.status
FROM triples t JOIN (VALUES ('won', 'winner'), ('nominated', 'nominated')) v(p, status) ON t.property = v.p
""")
def c15_values_join(spark, sf):
    """Facts joined to an inline VALUES table of (property, status)."""
    t = Fixtures(spark, sf).triples
    vals = TR.values_table(spark, ["p", "status"], [("won", "winner"), ("nominated", "nominated")])
    return TR.match_pattern(t, [("?s", "?p", "?award")], values=vals).select("s", "award", "status")


@query("g2_union_distinct", oracle="""
SELECT subject AS s, object AS a FROM triples WHERE property = 'won'
UNION SELECT subject, object FROM triples WHERE property = 'nominated'
""")
def g2_union_distinct(spark, sf):
    """Union of two pattern branches with duplicates removed."""
    t = Fixtures(spark, sf).triples
    return TR.union_distinct(TR.triple_pattern(t, ("?s", "won", "?a")), TR.triple_pattern(t, ("?s", "nominated", "?a")))


@query("c13_alternative_path_bgp", oracle="""
SELECT DISTINCT t.subject AS s, n.object AS nation FROM triples t
JOIN triples n ON n.subject = t.subject AND n.property = 'nation'
WHERE t.property IN ('won', 'nominated')
""")
def c13_alternative_path_bgp(spark, sf):
    """Subjects with either of two properties and their nation, DISTINCT."""
    t = Fixtures(spark, sf).triples
    return TR.match_pattern(t, [("?s", "won|nominated", "?a"), ("?s", "nation", "?nation")],
                            select=["s", "nation"], distinct=True)


@query("d24_group_as_distinct", oracle="""
SELECT object AS nation, CAST(count(DISTINCT subject) AS BIGINT) AS n_members
FROM triples WHERE property = 'nation' GROUP BY object
""")
def d24_group_as_distinct(spark, sf):
    """Distinct members per nation."""
    p = TR.triple_pattern(Fixtures(spark, sf).triples, ("?s", "nation", "?nation"))
    return p.groupBy("nation").agg(F.count_distinct("s").cast("bigint").alias("n_members"))


@query("i23_label_fallback", oracle="""
WITH s AS (SELECT DISTINCT subject FROM triples),
en AS (SELECT subject, min(object) AS o FROM triples WHERE property = 'label_en' GROUP BY subject),
mul AS (SELECT subject, min(object) AS o FROM triples WHERE property = 'label_mul' GROUP BY subject)
SELECT s.subject, coalesce(en.o, mul.o, s.subject) AS label
FROM s LEFT JOIN en USING (subject) LEFT JOIN mul USING (subject)
""")
def i23_label_fallback(spark, sf):
    """Label in the preferred language, else the other, else the id."""
    t = Fixtures(spark, sf).triples
    subs = t.select("subject").distinct()
    return TR.label_fallback(t, subs, "subject", ["label_en", "label_mul"])


# ---------------------------------------------------------------- J13 / C10 / D23
def _reduced(fx):
    return S.work_profiles(_clean(fx, ["work_id"]).join(_stats(fx), "work_id", "left"))


@query("j13_count_encode", oracle="WITH " + FEATURES + """,
ex AS (SELECT work_id, unnest(gender) AS gender FROM author_data)
SELECT work_id,
       CAST(count(*) FILTER (WHERE gender = 'female') AS BIGINT) AS gender_female,
       CAST(count(*) FILTER (WHERE gender = 'male') AS BIGINT) AS gender_male,
       CAST(count(*) FILTER (WHERE gender = 'non-binary') AS BIGINT) AS "gender_non-binary",
       CAST(count(*) FILTER (WHERE gender IS NULL) AS BIGINT) AS gender_None
FROM ex GROUP BY work_id
""")
def j13_count_encode(spark, sf):
    """Per-work counts of each author gender via the count encoder."""
    d = materialize(_reduced(Fixtures(spark, sf)).select("work_id", "gender"))      # read by fit and transform
    model = CountEncoder(["gender"], "work_id", 0.01).fit(d)
    return model.transform(d)


@query("j13_count_encode_infrequent", oracle="WITH " + FEATURES + """,
ex AS (SELECT work_id, unnest(birth_country) AS bc FROM author_data),
n AS (SELECT count(*) AS n FROM ex),
fr AS (SELECT bc FROM ex GROUP BY bc HAVING count(*) >= 0.05 * (SELECT n FROM n)),
lab AS (SELECT work_id,
               CASE WHEN EXISTS (SELECT 1 FROM fr WHERE fr.bc IS NOT DISTINCT FROM ex.bc)
                    THEN 'birth_country_' || coalesce(bc, 'None')
                    ELSE 'birth_country_infrequent_sklearn' END AS feature
        FROM ex)
SELECT work_id, feature, CAST(count(*) AS BIGINT) AS n FROM lab GROUP BY ALL
""")
def j13_count_encode_infrequent(spark, sf):
    """5% minimum: most countries fall into the shared infrequent bucket.
    Long form (work, feature, count > 0), so the check does not depend on
    which values happen to be frequent at a given scale."""
    d = materialize(_reduced(Fixtures(spark, sf)).select("work_id", "birth_country"))      # read by fit and transform
    model = CountEncoder(["birth_country"], "work_id", 0.05).fit(d)
    wide = model.transform(d)
    feats = model.feature_names()
    return (wide.unpivot("work_id", feats, "feature", "n").filter(F.col("n") > 0))


@query("c10_encoder_rejoin", oracle="WITH " + FEATURES + """,
ex AS (SELECT work_id, unnest(gender) AS gender FROM author_data),
enc AS (SELECT work_id, CAST(count(*) FILTER (WHERE gender = 'female') AS BIGINT) AS gender_female,
               CAST(count(*) FILTER (WHERE gender = 'male') AS BIGINT) AS gender_male,
               CAST(count(*) FILTER (WHERE gender = 'non-binary') AS BIGINT) AS "gender_non-binary",
               CAST(count(*) FILTER (WHERE gender IS NULL) AS BIGINT) AS gender_None
        FROM ex GROUP BY work_id)
SELECT f.work_id, f.year, f.n_win, round(f.mean_age, 6) AS mean_age, e.* EXCLUDE (work_id)
FROM features f JOIN enc e USING (work_id)
""")
def c10_encoder_rejoin(spark, sf):
    """The encoded counts joined back to the untouched feature columns."""
    fx = Fixtures(spark, sf)
    feats = S.cohort_features(_clean(fx, ["work_id"]).join(_stats(fx), "work_id", "left"))
    model = CountEncoder(["gender"], "work_id", 0.01).fit(feats.select("work_id", "gender"))
    out = model.transform(feats.select("work_id", "year", "n_win", "mean_age", "gender"))
    return out.withColumn("mean_age", F.round("mean_age", 6))


@query("d23_one_hot_sums", oracle="""
SELECT year, CAST(count(*) FILTER (WHERE gender = 'female') AS BIGINT) AS gender_female,
       CAST(count(*) FILTER (WHERE gender = 'male') AS BIGINT) AS gender_male,
       CAST(count(*) FILTER (WHERE gender = 'non-binary') AS BIGINT) AS "gender_non-binary"
FROM cohort GROUP BY year
""")
def d23_one_hot_sums(spark, sf):
    """Per-year counts of each gender value via the count encoder."""
    c = Fixtures(spark, sf).cohort.select("year", F.array("gender").alias("gender"))
    return CountEncoder(["gender"], "year", 0.01).fit(c).transform(c, counts_only=True)


# ---------------------------------------------------------------- J16
def _cohort_totals(fx):
    c = fx.cohort
    c = R.cohort_total(c, "year", "n_nom_all", "tot_cohort_nom")
    return R.cohort_total(c, "year", "n_win", "tot_cohort_awards")


@query("j16_naive_expected", oracle="""
SELECT work_id, year, round(sum(n_win) OVER (PARTITION BY year) * n_nom_all / sum(n_nom_all) OVER (PARTITION BY year), 6) AS expected_wins
FROM cohort
""")
def j16_naive_expected(spark, sf):
    """Expected wins of the naive baseline: N_win * n / sum(n) per cohort."""
    e = C.naive_expected(_cohort_totals(Fixtures(spark, sf)))
    return e.select("work_id", "year", F.round("expected_wins", 6).alias("expected_wins"))


@query("j16_naive_winners", oracle="""
SELECT year, CAST(sum(n_win) AS BIGINT) AS drawn_wins FROM cohort GROUP BY year
""")
def j16_naive_winners(spark, sf):
    """Seeded multinomial draw per cohort; the oracle checks the invariant
    that every cohort receives exactly its number of wins."""
    d = C.naive_winners(_cohort_totals(Fixtures(spark, sf)), "work_id", seed=11)
    return d.groupBy("year").agg(F.sum("naive_wins").cast("bigint").alias("drawn_wins"))


@query("j16_naive_winners_rows")
def j16_naive_winners_rows(spark, sf):
    """Seeded multinomial draw of each cohort's wins (rows-only)."""
    return C.naive_winners(_cohort_totals(Fixtures(spark, sf)), "work_id", seed=11) \
        .select("work_id", "year", "naive_wins")


# ---------------------------------------------------------------- J20 / J21
SOFTMAX = """
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY year)) AS e FROM cohort),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY year) AS p_win FROM e)"""


@query("j20_multinomial_ce_loss", oracle="WITH " + SOFTMAX + """
SELECT year, round(sum(CASE WHEN n_win > 0 THEN -n_win * ln(p_win) ELSE 0 END) / sum(n_win), 6) AS loss
FROM p GROUP BY year
""")
def j20_multinomial_ce_loss(spark, sf):
    """Per-cohort loss -sum(N_i/N_win ln p_i) with softmax probabilities."""
    p = C.cohort_softmax(Fixtures(spark, sf).cohort, "year", "score", log_out="ln_p")
    return C.multinomial_ce_loss(p, "year", "n_win", "p_win", log_p="ln_p").withColumn("loss", F.round("loss", 6))


@query("j20_total_loss_unnormalised", oracle="WITH " + SOFTMAX + """
SELECT round(sum(l), 6) AS total_loss FROM (
  SELECT year, sum(CASE WHEN n_win > 0 THEN -n_win * ln(p_win) ELSE 0 END) AS l FROM p GROUP BY year)
""")
def j20_total_loss_unnormalised(spark, sf):
    """Sum over cohorts of the loss without the 1/N_win factor."""
    p = C.cohort_softmax(Fixtures(spark, sf).cohort, "year", "score")
    per = C.multinomial_ce_loss(p, "year", "n_win", "p_win", normalize=False)
    return C.total_loss(per).withColumn("total_loss", F.round("total_loss", 6))


@query("j21_classification_kpis", oracle="""
WITH t AS (SELECT *, sum(n_win) OVER (PARTITION BY year) AS tot FROM cohort),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY score DESC, work_id) <= tot AS INT) AS pred FROM t),
c AS (SELECT count(*) FILTER (WHERE n_win > 0 AND pred > 0) AS tp, count(*) FILTER (WHERE n_win <= 0 AND pred > 0) AS fp,
             count(*) FILTER (WHERE n_win > 0 AND pred <= 0) AS fn, count(*) FILTER (WHERE n_win <= 0 AND pred <= 0) AS tn FROM r)
SELECT tp, fp, fn, tn, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
       round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c
""")
def j21_classification_kpis(spark, sf):
    """Confusion counts, balanced accuracy and F1 of top-N predictions."""
    c = R.cohort_total(Fixtures(spark, sf).cohort, "year", "n_win", "tot")
    pred = C.pick_winners(c, "year", "score", "tot", "work_id", out="pred")
    k = C.classification_kpis(pred, "n_win", "pred")
    return k.select("tp", "fp", "fn", "tn", F.round("balanced_accuracy", 6).alias("balanced_accuracy"),
                    F.round("f1", 6).alias("f1"))


@query("j22_fit_cohort_ranker", oracle="""
WITH RECURSIVE base AS (SELECT year, CAST(n_win AS DOUBLE) / sum(n_win) OVER (PARTITION BY year) AS y, coalesce(score, 0) AS a, coalesce(age, 0) AS b,
       sum(n_win) OVER (PARTITION BY year) AS nc FROM cohort QUALIFY nc > 0),
sc AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM base),
z AS (SELECT year, y, (a - ma) / sa AS a, (b - mb) / sb AS b FROM base, sc),
t AS (SELECT avg(t1) AS t1, avg(t2) AS t2 FROM (SELECT year, sum(y * a) AS t1, sum(y * b) AS t2 FROM z GROUP BY year)),
newton AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2
  UNION ALL
  SELECT k + 1, b1 - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b2 - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
  FROM (SELECT k, b1, b2, avg(e1) - max(t1) AS g1, avg(e2) - max(t2) AS g2, avg(e11 - e1 * e1) AS h11, avg(e12 - e1 * e2) AS h12, avg(e22 - e2 * e2) AS h22
        FROM (SELECT k, b1, b2, year, sum(e * a) / sum(e) AS e1, sum(e * b) / sum(e) AS e2, sum(e * a * a) / sum(e) AS e11,
                     sum(e * a * b) / sum(e) AS e12, sum(e * b * b) / sum(e) AS e22
              FROM (SELECT k, b1, b2, year, a, b, exp(b1 * a + b2 * b) AS e FROM newton, z WHERE k < 25) GROUP BY k, b1, b2, year), t
        GROUP BY k, b1, b2))
SELECT 'score' AS feature, round(b1 / sa, 6) AS coefficient FROM newton, sc WHERE k = 25
UNION ALL SELECT 'age', round(b2 / sb, 6) FROM newton, sc WHERE k = 25
""")
def j22_fit_cohort_ranker(spark, sf):
    """Conditional-logit coefficients for (score, age) at the optimum."""
    c = Fixtures(spark, sf).cohort
    beta = C.fit_cohort_ranker(c, "year", ["score", "age"], "n_win")
    return spark.createDataFrame([(f, round(float(b), 6)) for f, b in zip(["score", "age"], beta)],
                                 "feature STRING, coefficient DOUBLE")


# ---------------------------------------------------------------- J24
@query("j24_mutual_information", oracle="""
WITH base AS (SELECT score, age, CAST(n_win > 0 AS INT) AS won FROM cohort),
rs AS (SELECT min(score) AS lo, max(score) AS hi FROM base),
ra AS (SELECT min(age) AS lo, max(age) AS hi FROM base),
xs AS (SELECT coalesce(least(floor((score - rs.lo) / nullif(rs.hi - rs.lo, 0) * 10), 9), 0) AS bx, won AS y
       FROM base, rs WHERE score IS NOT NULL),
xa AS (SELECT coalesce(least(floor((age - ra.lo) / nullif(ra.hi - ra.lo, 0) * 10), 9), 0) AS bx, won AS y
       FROM base, ra WHERE age IS NOT NULL),
js AS (SELECT bx, y, count(*) AS nxy FROM xs GROUP BY ALL),
ja AS (SELECT bx, y, count(*) AS nxy FROM xa GROUP BY ALL),
ms AS (SELECT nxy, sum(nxy) OVER (PARTITION BY bx) AS nx, sum(nxy) OVER (PARTITION BY y) AS ny, sum(nxy) OVER () AS n FROM js),
ma AS (SELECT nxy, sum(nxy) OVER (PARTITION BY bx) AS nx, sum(nxy) OVER (PARTITION BY y) AS ny, sum(nxy) OVER () AS n FROM ja)
SELECT 'score' AS feature, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS mi FROM ms
UNION ALL
SELECT 'age', round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) FROM ma
""")
def j24_mutual_information(spark, sf):
    """Binned mutual information of score and age with the won flag."""
    c = Fixtures(spark, sf).cohort.select("score", "age", (F.col("n_win") > 0).cast("int").alias("won"))
    mi = ST.binned_mutual_information(c, ["score", "age"], "won", bins=10)
    return mi.withColumn("mi", F.round("mi", 6))

def _nearest_sql(feature: str) -> str:
    """All pairs in SQL: exact distances in steps of 2**-44, equal values told apart by a hash of the id."""
    step = lambda c: (f"CAST(floor({c} / (SELECT stddev_pop({c}) FROM b_{feature}) * 17592186044416.0) AS BIGINT) "  # noqa: E731
                      f"+ CAST('0x' || substr(md5(concat(work_id, ':{c}')), 1, 5) AS BIGINT) - 524288")
    psi = lambda n: (f"(ln({n} + 8.0) - 1 / (2 * ({n} + 8.0)) - 1 / (12 * pow({n} + 8.0, 2)) + 1 / (120 * pow({n} + 8.0, 4)) "  # noqa: E731
                     f"- 1 / (252 * pow({n} + 8.0, 6)) + 1 / (240 * pow({n} + 8.0, 8))" + "".join(f" - 1 / ({n} + {j}.0)" for j in range(8)) + ")")
    return f"""b_{feature} AS (SELECT work_id, CAST({feature} AS DOUBLE) AS {feature}, CAST(n_win AS DOUBLE) AS n_win FROM cohort
       WHERE {feature} IS NOT NULL AND n_win IS NOT NULL),
p_{feature} AS (SELECT work_id, {step(feature)} AS x, {step("n_win")} AS y FROM b_{feature}),
r_{feature} AS (SELECT a.work_id, any_value(a.x) AS x, any_value(a.y) AS y,
       list_sort(list(greatest(abs(a.x - b.x), abs(a.y - b.y))))[3] - 1 AS r
       FROM p_{feature} a JOIN p_{feature} b ON a.work_id <> b.work_id GROUP BY a.work_id),
n_{feature} AS (SELECT a.work_id, count(*) FILTER (WHERE abs(a.x - b.x) <= a.r) AS nx, count(*) FILTER (WHERE abs(a.y - b.y) <= a.r) AS ny
       FROM r_{feature} a JOIN p_{feature} b ON abs(a.x - b.x) <= a.r OR abs(a.y - b.y) <= a.r GROUP BY a.work_id),
m_{feature} AS (SELECT '{feature}' AS feature, count(*) AS n, {psi("count(*)")} + {psi("3")} - avg({psi("nx")} + {psi("ny")}) AS mi FROM n_{feature})"""


@query("j24_nearest_mutual_information", oracle=f"""WITH {_nearest_sql("score")}, {_nearest_sql("age")}
SELECT feature, n, round(greatest(mi, 0), 6) AS mi FROM m_score UNION ALL SELECT feature, n, round(greatest(mi, 0), 6) FROM m_age
""")
def j24_nearest_mutual_information(spark, sf):
    """Nearest-neighbour mutual information (k = 3) of score and age with the number of wins."""
    from wreath.operators.relevance import nearest_mutual_information

    mi = nearest_mutual_information(Fixtures(spark, sf).cohort, ["score", "age"], "n_win", "work_id", k=3)
    return mi.withColumn("mi", F.round("mi", 6))


@query("j20_weighted_total_loss", oracle="WITH " + SOFTMAX + """,
l AS (SELECT year, sum(CASE WHEN n_win > 0 THEN -n_win * ln(p_win) ELSE 0 END) / sum(n_win) AS loss,
             max(n_nom_all_tot) AS w
      FROM (SELECT *, sum(n_nom_all) OVER (PARTITION BY year) AS n_nom_all_tot FROM p) GROUP BY year)
SELECT round(sum(loss * w / (SELECT sum(w) FROM l)), 6) AS total_loss FROM l
""")
def j20_weighted_total_loss(spark, sf):
    """Per-cohort normalised losses combined with cohort weights (each
    cohort's share of all nominations)."""
    c = R.cohort_total(Fixtures(spark, sf).cohort, "year", "n_nom_all", "__tot")
    p = C.cohort_softmax(c, "year", "score")
    per = C.multinomial_ce_loss(p, "year", "n_win", "p_win", weight="__tot")
    wsum = per.agg(F.sum("__tot").alias("s")).first()["s"]
    per = per.withColumn("__w", F.col("__tot") / F.lit(float(wsum)))
    return C.total_loss(per, weight="__w").withColumn("total_loss", F.round("total_loss", 6))


# ---------------------------------------------------------------- G4 (merge and split)
from wreath.plans.queries_linkage import FIXED_MODEL, J26_SQL  # noqa: E402
from wreath.plans.queries_nomination import CLEAN  # noqa: E402
from wreath.plans.queries_topics import J29_SQL, _stream  # noqa: E402


def _wrap(sql: str) -> str:
    return "(" + sql.strip() + ")"


@query("g4_merge_and_split", oracle="WITH " + CLEAN + f""",
topi AS {_wrap(J29_SQL)},
st AS {_wrap(J26_SQL)},
merged AS (
  SELECT c.*, t.topicality, s."max", s."count", s."median"
  FROM clean c
  LEFT JOIN (SELECT vec_id AS work_id, topicality FROM topi) t USING (work_id)
  LEFT JOIN st s USING (work_id))
SELECT 'train' AS split, * FROM merged WHERE year >= 1995 AND year < 1999
UNION ALL
SELECT 'test' AS split, * FROM merged WHERE year >= 1999 AND year < 2001
""")
def g4_merge_and_split(spark, sf):
    """The final stage: nomination table left-joined with topicality (works
    that have a description vector) and bestseller statistics (fan-out kept,
    Q6), then the temporal train/test split."""
    from wreath.operators import topics as TP
    fx = Fixtures(spark, sf)
    docs = fx.vec.select("vec_id", "embedding", (1996 + F.col("vec_id") % 2).cast("int").alias("year"))
    topi = TP.topicality(docs, "vec_id", "embedding", ["year"], _stream(fx), "embedding", "topic", "month")
    topi = topi.select(F.col("vec_id").alias("work_id"), F.round("topicality", 6).alias("topicality"))
    stats = S.bestseller_match(fx.catalog_a, fx.catalog_b, fx.ranks, model=FIXED_MODEL)
    # stored are the tables that meet, not the merged one: it has a row for each nomination and list year of each
    # linked title, which leave the join as they are made, and only those of the two ranges of years
    merged = S.merge_features(materialize(_clean(fx, ["work_id"])), materialize(topi), materialize(stats))
    train, test = R.temporal_split(merged, "year", (1995, 1999), (1999, 2001))
    return (train.select(F.lit("train").alias("split"), "*")
            .unionByName(test.select(F.lit("test").alias("split"), "*")))
