"""Minimum slice: group counts and running totals (the cumulative-awards stage)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wreath.operators.relational import cumulative_counts
from wreath.plans.fixtures import Fixtures
from wreath.plans.registry import query


@query("d1_group_count", oracle="""
SELECT author_id, author_label, year, CAST(count(award) AS BIGINT) AS award_count
FROM awards GROUP BY author_id, author_label, year
""")
def d1_group_count(spark, sf):
    """Non-null award count per (author, label, year)."""
    a = Fixtures(spark, sf).awards
    return a.groupBy("author_id", "author_label", "year").agg(
        F.count("award").cast("bigint").alias("award_count"))


@query("e1_running_sum", oracle="""
WITH per_year AS (
  SELECT author_id, author_label, year, count(award) AS award_count
  FROM awards GROUP BY author_id, author_label, year)
SELECT author_id, author_label, year,
       CAST(sum(award_count) OVER (PARTITION BY author_id ORDER BY year) AS BIGINT) AS awards_as_of_year
FROM per_year
""")
def e1_running_sum(spark, sf):
    """Awards per (author, year) and their running total per author (RANGE frame)."""
    a = Fixtures(spark, sf).awards
    return cumulative_counts(a, ["author_id", "author_label"], "year", "award",
                             out="awards_as_of_year")
