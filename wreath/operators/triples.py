"""Graph-pattern queries over a (subject, property, object) triples table.

A pattern is three terms; a term starting with ``?`` is a variable, anything
else a constant. Each pattern becomes a filtered projection of the triples
table with one column per variable; patterns are combined with equi joins
on their shared variables (inner for required, left for OPTIONAL). Property
constants are pushed into the scan filter, so each join input is already
narrowed to one or two properties.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Pattern = tuple[str, str, str]
POSITIONS = ("subject", "property", "object")


def _is_var(t: str) -> bool:
    return t.startswith("?")


def triple_pattern(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """Rows matching one pattern; columns are its variables (without ``?``).
    A property term may list alternatives separated by ``|``."""
    df = triples
    for pos, term in zip(POSITIONS, pattern):
        if _is_var(term):
            continue
        if pos == "property" and "|" in term:
            df = df.filter(F.col(pos).isin(*term.split("|")))
        else:
            df = df.filter(F.col(pos) == term)
    at: dict[str, str] = {}
    for pos, term in zip(POSITIONS, pattern):  # the same variable twice: equal values
        if _is_var(term) and at.setdefault(term, pos) != pos:
            df = df.filter(F.col(at[term]) == F.col(pos))
    return df.select(*[F.col(pos).alias(term[1:]) for term, pos in at.items()])


def _join(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("patterns share no variable (a cross product is refused)")
    return a.join(b, shared, how)


def _join_connected(parts: Sequence[DataFrame]) -> DataFrame:
    """Inner join of all parts, always taking the first that shares a column."""
    out, left = parts[0], list(parts[1:])
    while left:
        nxt = next((p for p in left if set(p.columns) & set(out.columns)), left[0])
        left.remove(nxt)
        out = _join(out, nxt, "inner")
    return out


def match_pattern(triples: DataFrame, patterns: Sequence[Pattern],
                  optional: Sequence[Sequence[Pattern]] = (), values: DataFrame | None = None,
                  select: Sequence[str] | None = None, distinct: bool = False) -> DataFrame:
    """Basic graph pattern (inner joins), then OPTIONAL groups (left joins).
    A VALUES table comes first, so that its few rows narrow every join after
    it. Patterns are joined in any order in which each shares a variable with
    those before it."""
    parts = [triple_pattern(triples, p) for p in patterns]
    out = _join_connected([values, *parts] if values is not None else parts)
    for group in optional:
        g = _join_connected([triple_pattern(triples, p) for p in group])
        out = _join(out, g, "left")
    if select:
        out = out.select(*select)
    return out.distinct() if distinct else out


def path(triples: DataFrame, start: str, properties: Sequence[str], end: str) -> DataFrame:
    """Property path ``p1/p2/...`` from ``?start`` to ``?end`` (fixed length)."""
    pats = []
    prev = start
    for i, p in enumerate(properties):
        nxt = end if i == len(properties) - 1 else f"?__hop{i}"
        pats.append((prev, p, nxt))
        prev = nxt
    out = match_pattern(triples, pats)
    return out.select(start[1:], end[1:])


def values_table(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """Inline VALUES: a literal table (its size is what the query spells
    out), broadcast into the join."""
    schema = ", ".join(f"{n} STRING" for n in names)
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs).distinct()


def label_fallback(triples: DataFrame, subject_df: DataFrame, subject: str,
                   label_props: Sequence[str], out: str = "label") -> DataFrame:
    """Label in the first language that has one, else the id itself."""
    df = subject_df
    for i, p in enumerate(label_props):
        lab = triples.filter(F.col("property") == p).select(
            F.col("subject").alias(subject), F.col("object").alias(f"__lab{i}"))
        lab = lab.groupBy(subject).agg(F.min(f"__lab{i}").alias(f"__lab{i}"))
        df = df.join(lab, subject, "left")
    labs = [F.col(f"__lab{i}") for i in range(len(label_props))]
    return df.withColumn(out, F.coalesce(*labs, F.col(subject))).drop(*[f"__lab{i}" for i in range(len(label_props))])
