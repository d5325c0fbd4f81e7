"""Sources and sinks: round trips through every format the workload uses,
JSON shaping, named relations, parameterised SQL, request caches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wreath.plans import stages as S
from wreath.plans.fixtures import Fixtures
from wreath.plans.registry import query
from wreath.session import materialize
from wreath.sources import io as IO
from wreath.sources.io import scratch_path

AWARDS_JSON_SCHEMA = T.StructType([
    T.StructField("author_id", T.LongType()), T.StructField("author_label", T.StringType()),
    T.StructField("award", T.StringType()), T.StructField("year", T.StringType())])


# ---------------------------------------------------------------- A1
@query("a1_scan_ndjson", oracle="""
SELECT author_id, author_label, award, year FROM awards
""")
def a1_scan_ndjson(spark, sf):
    """Year written as a JSON string (as the monthly files hold it), read as
    string and cast: an int schema over a quoted number would give null."""
    a = Fixtures(spark, sf).awards
    path = scratch_path(spark, "a1")
    IO.write_table(a.withColumn("year", F.col("year").cast("string")), path, "json")
    back = IO.read_table(spark, path, "json", AWARDS_JSON_SCHEMA)
    return IO.cast_columns(back, {"year": "int"})


# ---------------------------------------------------------------- A2 / A6
DESC_SCHEMA = "work_id LONG, pos LONG, description STRING"


@query("a2_scan_csv_multiline", oracle="""
SELECT work_id, pos, description FROM tier1
""")
def a2_scan_csv_multiline(spark, sf):
    """CSV with quoted multi-line text written and read back with a declared schema."""
    t = Fixtures(spark, sf).tier1
    path = scratch_path(spark, "a2")
    IO.write_table(t, path, "csv")
    return IO.read_table(spark, path, "csv", DESC_SCHEMA)


@query("a6_write_csv", oracle="""
SELECT work_id, description FROM manual WHERE description IS NOT NULL
""")
def a6_write_csv(spark, sf):
    """A table written as CSV with header (one job), read back."""
    m = Fixtures(spark, sf).manual.dropna(subset=["description"])
    path = scratch_path(spark, "a6")
    IO.write_table(m, path, "csv")
    return IO.read_table(spark, path, "csv", "work_id LONG, description STRING")


# ---------------------------------------------------------------- A3
@query("a3_scan_tsv", oracle="""
SELECT list_row, title_id, year, rank FROM ranks
""")
def a3_scan_tsv(spark, sf):
    """Tab-separated list rows written and read back."""
    r = Fixtures(spark, sf).ranks
    path = scratch_path(spark, "a3")
    IO.write_table(r, path, "tsv")
    return IO.read_table(spark, path, "tsv", "list_row LONG, title_id LONG, year INT, rank LONG")


# ---------------------------------------------------------------- A4
@query("a4_scan_parquet_lists", oracle="""
SELECT vec_id, label, len(embedding) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings
""")
def a4_scan_parquet_lists(spark, sf):
    """Parquet with a list column read directly; per-row length and sum."""
    e = IO.read_table(spark, f"{sf.rstrip('/')}/embeddings.parquet", "parquet")
    tot = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", "label", F.size("embedding").cast("bigint").alias("dim"),
                    F.round(tot, 6).alias("total"))


# ---------------------------------------------------------------- A5 / A10
@query("a10_write_partitioned", oracle="""
SELECT doc_id, topic, year, month FROM topic_month
""")
def a10_write_partitioned(spark, sf):
    """One folder per (year, month), then a partition-pruned read back."""
    t = Fixtures(spark, sf).topic_month
    path = scratch_path(spark, "a10")
    IO.write_table(t, path, "json", partition_by=["year", "month"])
    back = spark.read.schema("doc_id LONG, topic STRING, year INT, month INT").json(path)
    return back


@query("a5_scan_many", oracle="""
SELECT doc_id, topic, year, month FROM topic_month
""")
def a5_scan_many(spark, sf):
    """Many monthly files read as one batch: an explicit list of every
    (year, month) file (the calendar of the data, a bounded list), as the
    monthly inputs are listed."""
    t = Fixtures(spark, sf).topic_month
    path = scratch_path(spark, "a5")
    IO.write_table(t, path, "json", partition_by=["year", "month"])
    months = sorted((r["year"], r["month"]) for r in t.select("year", "month").distinct().collect())
    files = [f"{path}/year={y}/month={m}" for y, m in months]
    return (spark.read.schema("doc_id LONG, topic STRING, year INT, month INT")
            .option("basePath", path).json(files))


# ---------------------------------------------------------------- A7 / A8
@query("a7_copy_table", oracle="""
SELECT author_id, author_label, year,
       CAST((SELECT count(b.award) FROM awards b
             WHERE b.author_id = a.author_id AND b.year <= a.year) AS BIGINT) AS awards_as_of_year
FROM (SELECT DISTINCT author_id, author_label, year FROM awards) a
""")
def a7_copy_table(spark, sf):
    """A query result (running award totals) exported to CSV and read back."""
    path = scratch_path(spark, "a7")
    IO.write_table(S.cumulative_awards(Fixtures(spark, sf).awards), path, "csv")
    return IO.read_table(spark, path, "csv",
                         "author_id LONG, author_label STRING, year INT, awards_as_of_year LONG")


@query("a8_single_write_not_append", oracle="""
SELECT year, topic, CAST(count(*) AS BIGINT) AS n FROM topic_month GROUP BY year, topic
""")
def a8_single_write_not_append(spark, sf):
    """All per-year groups written by one job (overwrite): reruns do not
    duplicate rows and the header is not repeated inside the data."""
    t = Fixtures(spark, sf).topic_month.groupBy("year", "topic").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    path = scratch_path(spark, "a8")
    IO.write_table(t, path, "csv")
    IO.write_table(t, path, "csv")  # a rerun replaces, never appends
    return IO.read_table(spark, path, "csv", "year INT, topic STRING, n LONG")


# ---------------------------------------------------------------- A9
@query("a9_write_parquet_zstd", oracle="""
SELECT vec_id, label, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings
""")
def a9_write_parquet_zstd(spark, sf):
    """Parquet written with zstd level 15, read back."""
    e = Fixtures(spark, sf).vec
    path = scratch_path(spark, "a9")
    IO.write_table(e, path, "parquet", codec="zstd", level=15)
    back = spark.read.parquet(path)
    tot = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return back.select("vec_id", "label", F.round(tot, 6).alias("total"))


# ---------------------------------------------------------------- A11
def nested_responses(fx):
    """Archive-style responses: events chunked 50 per response (bounded JSON
    rows), each chunk one document with year and month as strings."""
    e = fx.events
    doc = F.struct(
        F.col("event_id").cast("string").alias("_id"),
        F.when(F.col("event_type") == "view", F.lit("1")).otherwise(F.lit("A2")).alias("print_page"),
        F.struct(F.concat(F.when(F.col("event_id") % 3 == 0, F.lit("LEAD:")).otherwise(F.lit("")),
                          F.initcap(F.col("event_type")), F.lit(" Report "), F.col("user_id").cast("string"))
                 .alias("print_headline")).alias("headline"),
        F.col("props").alias("abstract"))
    chunk = F.floor(F.col("event_id") / 50)
    return (e.groupBy(chunk.alias("chunk"), F.year("ts").cast("string").alias("year"),
                      F.month("ts").cast("string").alias("month"))
            .agg(F.to_json(F.struct(F.struct(F.collect_list(doc).alias("docs")).alias("response"))).alias("json")))


HEADLINE_SQL = """CASE WHEN event_id % 3 = 0 THEN 'LEAD:' ELSE '' END ||
       upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Report ' || CAST(user_id AS STRING)"""


@query("a11_flatten_docs", oracle=f"""
SELECT CAST(event_id AS STRING) AS id, {HEADLINE_SQL} AS headline, props AS abstract,
       CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month
FROM events WHERE event_type = 'view'
""")
def a11_flatten_docs(spark, sf):
    """Archive responses (JSON) exploded to one row per front-page article, year and month stamped and cast."""
    return IO.flatten_docs(nested_responses(Fixtures(spark, sf)), "json")


# ---------------------------------------------------------------- A12
ENTITY = "http://www.wikidata.org/entity/"


def bindings(fx):
    e = fx.events
    b = F.create_map(
        F.lit("item"), F.struct(F.concat(F.lit(ENTITY + "Q"), F.col("event_id").cast("string")).alias("value")),
        F.lit("k"), F.struct(F.col("props").alias("value")))
    lab = F.when(F.col("event_type") != "error",
                 F.create_map(F.lit("label"), F.struct(F.col("event_type").alias("value"))))
    m = F.when(lab.isNull(), b).otherwise(F.map_concat(b, lab))
    return e.select("event_id", F.to_json(m).alias("json"))


@query("a12_flatten_bindings", oracle=f"""
SELECT event_id, '{ENTITY}Q' || CAST(event_id AS STRING) AS item,
       CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS label, props AS k
FROM events
""")
def a12_flatten_bindings(spark, sf):
    """Query bindings {k: {value: v}} flattened to one column per key, null where absent."""
    return IO.flatten_bindings(bindings(Fixtures(spark, sf)), "json", ["item", "label", "k"], keep=["event_id"])


# ---------------------------------------------------------------- A13 / A14 / A17
@query("a13_register_view", oracle="""
SELECT year, CAST(count(*) AS BIGINT) AS n FROM cohort GROUP BY year
""")
def a13_register_view(spark, sf):
    """A DataFrame named as a temp view and queried with SQL."""
    Fixtures(spark, sf).cohort.createOrReplaceTempView("cohort_features")
    return spark.sql("SELECT year, CAST(count(*) AS BIGINT) AS n FROM cohort_features GROUP BY year")


@query("a14_parameterised_sql", oracle="""
SELECT topic, CAST(count(*) AS BIGINT) AS n FROM topic_month WHERE year >= 1996 AND year < 1999 GROUP BY topic
""")
def a14_parameterised_sql(spark, sf):
    """SQL with named parameter markers and IDENTIFIER(:t) for the table name."""
    fx = Fixtures(spark, sf)
    fx.view("topic_month")
    return spark.sql("SELECT topic, CAST(count(*) AS BIGINT) AS n FROM IDENTIFIER(:t) "
                     "WHERE year >= :lo AND year < :hi GROUP BY topic",
                     args={"t": "topic_month", "lo": 1996, "hi": 1999})


@query("a17_materialise_constants", oracle="""
SELECT label, CAST(count(*) AS BIGINT) AS n FROM vec GROUP BY label
""")
def a17_materialise_constants(spark, sf):
    """A result kept under a name: stored once, read by any number of queries."""
    v = Fixtures(spark, sf).vec
    return materialize(v.groupBy("label").agg(F.count(F.lit(1)).cast("bigint").alias("n")))


# ---------------------------------------------------------------- A15
@query("a15_pending_requests", oracle="""
WITH grid AS (
  SELECT y.year, m.month, CAST(y.year AS STRING) || '/' || CAST(m.month AS STRING) || '.json' AS path
  FROM (SELECT DISTINCT year FROM topic_month) y CROSS JOIN range(1, 13) m(month)),
cache AS (SELECT DISTINCT sha256(CAST(year AS STRING) || '/' || CAST(month AS STRING) || '.json') AS key
          FROM topic_month WHERE year < 1998 AND topic = 'burst0')
SELECT year, month, path FROM grid WHERE sha256(path) NOT IN (SELECT key FROM cache)
""")
def a15_pending_requests(spark, sf):
    """Request keys (SHA-256 of the path) not yet in the cache table: left anti join."""
    from wreath.operators.relational import calendar_grid
    t = Fixtures(spark, sf).topic_month
    path = lambda y, m: F.concat(F.col(y).cast("string"), F.lit("/"), F.col(m).cast("string"), F.lit(".json"))
    grid = calendar_grid(t, "year").withColumn("path", path("year", "month")) \
        .withColumn("key", IO.request_key("path"))
    cache = (t.filter((F.col("year") < 1998) & (F.col("topic") == "burst0"))
             .select(IO.request_key(path("year", "month")).alias("key")))
    return IO.pending_requests(grid, cache).select(F.col("year"), F.col("month").cast("bigint"), "path")
