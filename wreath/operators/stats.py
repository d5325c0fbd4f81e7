"""Group statistics behind the exploratory tables (intervals, box plots,
histograms), class weights and coverage counts. Each is one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def mean_interval(df: DataFrame, by, col: str, z: float = 1.96) -> DataFrame:
    """Mean per group with a normal ``z`` interval (sample standard error)."""
    n = F.count(col)
    se = F.stddev_samp(col) / F.sqrt(n)
    return df.groupBy(*_names(by)).agg(
        F.avg(col).alias("mean"), n.cast("bigint").alias("n"),
        (F.avg(col) - z * se).alias("lo"), (F.avg(col) + z * se).alias("hi"))


def five_number(df: DataFrame, by, col: str) -> DataFrame:
    """Min, quartiles (linear interpolation) and max per group, by counting
    (:func:`wreath.operators.ranges.exact_quantiles`): no task holds a group."""
    from wreath.operators.ranges import exact_quantiles

    return exact_quantiles(df, _names(by), col, (0.0, 0.25, 0.5, 0.75, 1.0))


def counted_median(df: DataFrame, by, col: str) -> DataFrame:
    """(by..., max, count, median) of a column with few distinct values, such as ranks: values are
    counted first, so a group is as large as its number of distinct values."""
    by = _names(by)
    n = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*by).agg(
        F.max(col).alias("max"), F.coalesce(F.sum(F.when(F.col(col).isNotNull(), F.col("__n"))), F.lit(0)).cast("bigint").alias("count"),
        F.percentile(F.col(col), 0.5, F.when(F.col(col).isNull(), F.lit(0)).otherwise(F.col("__n"))).alias("median"))


def histogram(df: DataFrame, col: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts per fixed-width bin; ``bin_lo`` is the bin's left edge."""
    b = (F.floor(F.col(col) / F.lit(width)) * F.lit(width)).alias("bin_lo")
    return (df.filter(F.col(col).isNotNull())
            .groupBy(*by, b).agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced class weight on every row: n / (n_classes * n_class); a null
    label has none. The counts are joined back on the label (AQE broadcasts
    them when they are small), whatever the number of classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    tot = counts.agg(F.sum("__nc").alias("n"), F.count(F.lit(1)).alias("k")).first()
    w = counts.select(label, (F.lit(float(tot["n"] or 0)) / (F.lit(float(tot["k"])) * F.col("__nc"))).alias(out))
    return df.join(w, label, "left")


def group_rate(df: DataFrame, by, num: str, den: str, out: str = "rate") -> DataFrame:
    """Σnum / Σden per group (null when Σden is 0)."""
    return df.groupBy(*_names(by)).agg(
        F.sum(num).alias(num), F.sum(den).alias(den),
        F.try_divide(F.sum(num).cast("double"), F.sum(den)).alias(out))


def non_null_counts(df: DataFrame) -> DataFrame:
    """One row: non-null count of every column (a table profile)."""
    return df.agg(*[F.count(F.col(c)).cast("bigint").alias(c) for c in df.columns])


def share_of_total(df: DataFrame, col: str, out: str = "share") -> DataFrame:
    """``col / sum(col)`` over the whole table: the total is one number,
    computed by one aggregate and applied as a literal (no unpartitioned
    window, no join)."""
    tot = df.agg(F.sum(col).alias("t")).first()["t"]
    return df.withColumn(out, F.try_divide(F.col(col).cast("double"), F.lit(tot)))


def dummies(df: DataFrame, col: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    """One 0/1 column per fitted value (``get_dummies`` with known values)."""
    prefix = prefix or col
    return df.select(*[c for c in df.columns if c != col],
                     *[(F.col(col) == F.lit(v)).cast("int").alias(f"{prefix}_{v}") for v in values])


def coverage_report(works: DataFrame, key: str, sources: Sequence[DataFrame]) -> DataFrame:
    """Works, works present in any source, and works missing from all."""
    covered = sources[0].select(key)
    for s in sources[1:]:
        covered = covered.unionByName(s.select(key))
    covered = covered.distinct()
    all_w = works.select(key).distinct()
    joined = all_w.join(covered.withColumn("__hit", F.lit(1)), key, "left")
    return joined.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_works"),
        F.count("__hit").cast("bigint").alias("n_covered"),
        (F.count(F.lit(1)) - F.count("__hit")).cast("bigint").alias("n_missing"))


def binned_mutual_information(df: DataFrame, features: Sequence[str], target: str,
                              bins: int = 10) -> DataFrame:
    """Mutual information (nats) between each feature, cut into ``bins``
    equal-width bins over its range, and a discrete target.

    Per feature: one aggregate for the range, one for the joint counts; the
    joint table has at most bins x |target| rows per feature."""
    parts = []
    ranges = df.agg(*[F.min(f).alias(f"lo_{i}") for i, f in enumerate(features)],
                    *[F.max(f).alias(f"hi_{i}") for i, f in enumerate(features)]).first()
    for i, f in enumerate(features):
        lo, hi = ranges[f"lo_{i}"], ranges[f"hi_{i}"]
        width = F.lit(float(hi - lo)) if lo is not None and hi != lo else F.lit(None).cast("double")
        x = (df.filter(F.col(f).isNotNull() & F.col(target).isNotNull())
             .select(F.least(F.floor((F.col(f) - F.lit(lo)) / width * bins),
                             F.lit(bins - 1)).alias("bx"),
                     F.col(target).alias("y")))
        x = x.withColumn("bx", F.coalesce(F.col("bx"), F.lit(0)))
        joint = x.groupBy("bx", "y").agg(F.count(F.lit(1)).alias("nxy"))
        wx, wy, wa = Window.partitionBy("bx"), Window.partitionBy("y"), Window.partitionBy()
        j = joint.select("nxy", F.sum("nxy").over(wx).alias("nx"), F.sum("nxy").over(wy).alias("ny"),
                         F.sum("nxy").over(wa).alias("n"))
        parts.append(j.agg(F.sum(F.col("nxy") / F.col("n") *
                                 F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny"))))
                           .alias("mi")).select(F.lit(f).alias("feature"), "mi"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
