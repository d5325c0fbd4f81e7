"""Fixture views: the reference's logical tables expressed over the test tables.

Every view is written once, in SQL that both Spark and DuckDB accept, so that
a DuckDB oracle starts from exactly the rows the Spark query starts from and
stays independent of this library's operators. Nulls are made on purpose with
residue rules because the test tables have none.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Shared SQL (Spark and DuckDB). Order matters: a view may use earlier ones.
FIXTURE_SQL: dict[str, str] = {
    # award_novels: one row per (work, author, award, status, year) record.
    "nom": """
SELECT l_orderkey AS ok, l_linenumber AS ln,
       l_partkey AS work_id, l_suppkey AS author_id,
       p_name AS title, s_name AS author_label,
       l_returnflag AS award,
       CASE WHEN l_linestatus = 'F' THEN 'winner' ELSE 'nominated' END AS status,
       CAST(year(l_shipdate) AS INT) AS year,
       CASE WHEN l_partkey % 50 = 7 THEN NULL
            ELSE concat(CAST(1960 + p_size AS STRING), '-',
                        lpad(CAST(1 + l_partkey % 12 AS STRING), 2, '0'), '-',
                        lpad(CAST(1 + l_partkey % 28 AS STRING), 2, '0'), 'T00:00:00Z') END AS pub_date,
       CASE WHEN l_partkey % 4 = 0 THEN NULL
            ELSE concat('gr', CAST(l_partkey AS STRING)) END AS goodreads_id,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL
            ELSE concat('OL', CAST(l_partkey * 2 + l_linenumber % 2 AS STRING), 'W') END AS openlibrary_id,
       CASE WHEN l_linenumber % 4 = 1 THEN NULL
            ELSE concat('978', CAST(l_partkey * 3 + l_linenumber % 3 AS STRING)) END AS isbn,
       CASE WHEN l_partkey % 5 = 0 THEN NULL
            ELSE concat('https://en.wikipedia.org/wiki/', replace(p_name, ' ', '_'),
                        CASE WHEN l_partkey % 7 = 0 THEN '%3A_Part+2' ELSE '' END) END AS article
FROM lineitem
JOIN part ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey
""",
    # awards_all: every award record of every author (lineitem only).
    "awards": """
SELECT l_suppkey AS author_id,
       concat('Author ', CAST(l_suppkey AS STRING)) AS author_label,
       CASE WHEN l_orderkey % 10 = 3 THEN NULL ELSE l_returnflag END AS award,
       CAST(year(l_shipdate) AS INT) AS year
FROM lineitem
""",
    # nominee_biographical: some authors carry two rows (fan-out, quirk Q5).
    "bio": """
SELECT s_suppkey AS author_id, s_name AS author_label,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL
            WHEN s_suppkey % 7 IN (1, 3) THEN 'female'
            WHEN s_suppkey % 7 = 6 THEN 'non-binary'
            ELSE 'male' END AS gender,
       CASE WHEN s_suppkey % 17 = 0 THEN NULL
            WHEN s_suppkey % 13 = 0 THEN 'unknown'
            ELSE concat(CAST(1930 + s_suppkey % 50 AS STRING), '-',
                        lpad(CAST(1 + s_suppkey % 12 AS STRING), 2, '0'), '-15T00:00:00Z') END AS dob,
       CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE n_name END AS birth_country
FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL
SELECT s_suppkey AS author_id, s_name AS author_label, 'female' AS gender,
       concat(CAST(1930 + s_suppkey % 50 AS STRING), '-06-01T00:00:00Z') AS dob,
       'ATLANTIS' AS birth_country
FROM supplier WHERE s_suppkey % 9 = 4
""",
    # bestseller lists: list rows; title ids land on the odd part keys.
    "ranks": """
SELECT event_id AS list_row, user_id * 2 + 1 AS title_id,
       CAST(day(ts) AS INT) AS year,
       CAST(floor(value) AS BIGINT) % 15 + 1 AS rank
FROM events
""",
    # two catalogues to link: list titles (odd keys) and nominated works (even keys).
    "catalog_a": """
SELECT p_partkey AS unique_id, p_name AS title,
       concat(p_type, ' ', p_brand) AS author, p_size AS year
FROM part WHERE p_partkey % 2 = 1
""",
    "catalog_b": """
SELECT p_partkey AS unique_id,
       CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, 's') ELSE p_name END AS title,
       concat(p_type, ' ', p_brand) AS author, p_size AS year
FROM part WHERE p_partkey % 2 = 0
""",
    # description answers by source tier; pos orders answers inside a tier.
    # every tier answers for every document, later ones with empty and null gaps elsewhere
    "tier1": """
SELECT CAST(floor(doc_id / 3) AS BIGINT) AS work_id, doc_id AS pos,
       CASE WHEN CAST(floor(doc_id / 3) AS BIGINT) % 5 = 0 OR doc_id % 7 = 0 THEN NULL ELSE text END AS description
FROM documents
""",
    "tier2": """
SELECT CAST(floor(doc_id / 3) AS BIGINT) AS work_id, doc_id AS pos,
       CASE WHEN CAST(floor(doc_id / 3) AS BIGINT) % 10 = 0 THEN NULL
            WHEN doc_id % 11 = 0 THEN '' ELSE concat('2: ', text) END AS description
FROM documents
""",
    "tier3": """
SELECT CAST(floor(doc_id / 3) AS BIGINT) AS work_id, doc_id AS pos,
       CASE WHEN CAST(floor(doc_id / 3) AS BIGINT) % 20 = 0 THEN '' ELSE concat('3: ', text) END AS description
FROM documents
""",
    # titles with their first author, for works that no other tier answers
    "tier4": """
SELECT CAST(floor(doc_id / 3) AS BIGINT) AS work_id, doc_id AS pos,
       CASE WHEN doc_id % 40 = 0 THEN NULL ELSE concat(source, ' by ', coalesce(lang, 'unknown')) END AS description
FROM documents
""",
    "manual": """
SELECT CAST(floor(doc_id / 3) AS BIGINT) AS work_id,
       CASE WHEN min(doc_id) % 11 = 0 THEN NULL ELSE concat('by hand: ', min(text)) END AS description
FROM documents GROUP BY CAST(floor(doc_id / 3) AS BIGINT)
""",
    "vec": """
SELECT vec_id, embedding, label FROM embeddings
""",
    "train_vec": """
SELECT vec_id, embedding, quality AS says_award
FROM embeddings JOIN labels ON doc_id = vec_id
""",
    # dated text stream with topics: a few "burst" topics live in one month.
    "topic_month": """
SELECT o_orderkey AS doc_id,
       CAST(year(o_orderdate) AS INT) AS year,
       CAST(month(o_orderdate) AS INT) AS month,
       CASE WHEN o_orderkey % 4 = 0 AND month(o_orderdate) = 1 + (o_custkey % 3) * 4
            THEN concat('burst', CAST(o_custkey % 3 AS STRING))
            ELSE o_orderpriority END AS topic
FROM orders
""",
    # entity facts as (subject, property, object) strings.
    "triples": """
SELECT concat('N', CAST(n_nationkey AS STRING)) AS subject, 'name' AS property, n_name AS object FROM nation
UNION ALL
SELECT concat('N', CAST(n_nationkey AS STRING)), 'region', concat('R', CAST(n_regionkey AS STRING)) FROM nation
UNION ALL
SELECT concat('N', CAST(n_nationkey AS STRING)), 'label_en', n_name FROM nation WHERE n_nationkey % 3 <> 0
UNION ALL
SELECT concat('N', CAST(n_nationkey AS STRING)), 'label_mul', lower(n_name) FROM nation WHERE n_nationkey % 2 = 0
UNION ALL
SELECT concat('R', CAST(r_regionkey AS STRING)), 'name', r_name FROM region
UNION ALL
SELECT concat('S', CAST(s_suppkey AS STRING)), 'name', s_name FROM supplier
UNION ALL
SELECT concat('S', CAST(s_suppkey AS STRING)), 'nation', concat('N', CAST(s_nationkey AS STRING)) FROM supplier
UNION ALL
SELECT concat('S', CAST(s_suppkey AS STRING)), 'won', concat('A', CAST(s_suppkey % 4 AS STRING)) FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL
SELECT concat('S', CAST(s_suppkey AS STRING)), 'nominated', concat('A', CAST(s_suppkey % 5 AS STRING)) FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL
SELECT concat('C', CAST(c_custkey AS STRING)), 'name', c_name FROM customer
UNION ALL
SELECT concat('C', CAST(c_custkey AS STRING)), 'nation', concat('N', CAST(c_nationkey AS STRING)) FROM customer
UNION ALL
SELECT concat('C', CAST(c_custkey AS STRING)), 'segment', c_mktsegment FROM customer WHERE c_custkey % 4 <> 0
UNION ALL
SELECT concat('S', CAST(l_suppkey AS STRING)),
       CASE WHEN l_linestatus = 'F' THEN 'award_received' ELSE 'nominated_for' END,
       concat('T', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING))
FROM lineitem
UNION ALL
SELECT concat('T', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING)),
       'award', concat('A', l_returnflag)
FROM lineitem
UNION ALL
SELECT concat('T', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING)),
       'point_in_time', CAST(year(l_shipdate) AS STRING)
FROM lineitem
""",
    # model features per work, year as cohort.
    "cohort": """
SELECT l_partkey AS work_id,
       CAST(1995 + l_partkey % 7 AS INT) AS year,
       count(*) AS n_nom_all,
       sum(CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 1 ELSE 0 END) AS n_win,
       round(CAST(l_partkey % 97 AS DOUBLE) / 10.0 - 4.0, 1) AS score,
       CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(30 + l_partkey % 50 AS DOUBLE) END AS age,
       CASE WHEN l_partkey % 3 = 0 THEN 'female' WHEN l_partkey % 3 = 1 THEN 'male' ELSE 'non-binary' END AS gender
FROM lineitem
GROUP BY l_partkey
""",
}

FIXTURE_NAMES = tuple(FIXTURE_SQL)
_WORD = {n: re.compile(rf"\b{n}\b") for n in (*FIXTURE_NAMES, *BASE_TABLES)}


def _refs(sql: str, names) -> list[str]:
    return [n for n in names if _WORD[n].search(sql)]


def _closure(sql: str) -> list[str]:
    """Fixtures used by ``sql``, with their own dependencies, in definition order."""
    need: set[str] = set()
    todo = _refs(sql, FIXTURE_NAMES)
    while todo:
        n = todo.pop()
        if n in need:
            continue
        need.add(n)
        todo.extend(_refs(FIXTURE_SQL[n], FIXTURE_NAMES))
    return [n for n in FIXTURE_NAMES if n in need]


def with_fixtures(sql: str) -> str:
    """Prefix a DuckDB oracle with the CTEs of every fixture it names."""
    names = _closure(sql)
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in names)
    body = sql.strip()
    if head := re.match(r"(?is)^with\s+(recursive\s+)?", body):
        return f"WITH {'RECURSIVE ' if head[1] else ''}{ctes},\n{body[head.end():]}"
    return f"WITH {ctes}\n{body}"


class Fixtures:
    """Lazily built fixture DataFrames for one session and one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from wreath.session import ship_package
        ship_package(spark)
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def _register(self, sql: str) -> None:
        for t in _refs(sql, BASE_TABLES):
            self.table(t).createOrReplaceTempView(t)
        for f in _closure(sql):
            if f not in self._views:
                self._register(FIXTURE_SQL[f])
                df = self.spark.sql(FIXTURE_SQL[f])
                self._views[f] = df
            self._views[f].createOrReplaceTempView(f)

    def view(self, name: str) -> DataFrame:
        self._register(name)
        return self._views[name]

    def sql(self, text: str, **args) -> DataFrame:
        """Run Spark SQL over base tables and fixtures (named markers allowed)."""
        self._register(text)
        return self.spark.sql(text, args=args or None)

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURE_SQL:
            return self.view(name)
        if name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)
