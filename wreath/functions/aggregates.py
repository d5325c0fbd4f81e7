"""Aggregate-valued helpers (Column -> Column). All are built-ins underneath, so
they keep partial (map-side) aggregation and whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mode_of(c) -> Column:
    """Most frequent non-null value; the smallest one on a tie."""
    return F.mode(_col(c), deterministic=True)


def count_where(cond: Column) -> Column:
    """Rows where ``cond`` is true, as bigint (0 for an empty group)."""
    return F.count_if(cond).cast("bigint")


def list_keep_nulls(c) -> Column:
    """``collect_list`` that keeps nulls (pandas ``list`` aggregation)."""
    c = _col(c)
    return F.transform(F.collect_list(F.struct(c.alias("v"))), lambda s: s["v"])


def ordered_list(value, *order) -> Column:
    """Values of a group in an explicit order, nulls kept."""
    s = F.struct(*[_col(o) for o in order], _col(value).alias("__v"))
    return F.transform(F.array_sort(F.collect_list(s)), lambda x: x["__v"])


def kurtosis_unbiased(c) -> Column:
    """Sample excess kurtosis (Fisher, bias corrected). Null for n < 4 or a
    constant series. Spark's ``kurtosis`` is the population form g2; the
    correction is G2 = ((n+1) g2 + 6)(n-1) / ((n-2)(n-3))."""
    c = _col(c)
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return F.when(n >= 4, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def first_nonnull_by(value, *order) -> Column:
    """First non-null ``value`` of a group by an explicit ascending order."""
    v = _col(value)
    key = F.struct(*[_col(o) for o in order])
    return F.min_by(v, F.when(v.isNotNull(), key))


def last_nonnull_by(value, *order) -> Column:
    """Last non-null ``value`` of a group by an explicit ascending order."""
    v = _col(value)
    key = F.struct(*[_col(o) for o in order])
    return F.max_by(v, F.when(v.isNotNull(), key))


def concat_distinct_by(df, keys, value: str, order, sep: str = " ", out: str | None = None):
    """Distinct ``value`` strings per group joined by ``sep`` in first-seen
    order (pandas ``" ".join(x.unique())``). Two aggregates: first position
    of each (group, value) pair, then one ordered list per group, so only
    distinct values are collected."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    first = df.groupBy(*keys, value).agg(F.min(F.struct(*[_col(o) for o in order])).alias("__p"))
    return first.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__p", value))),
                                 lambda x: x[value]), sep).alias(out or value))
