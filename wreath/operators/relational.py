"""Relational building blocks the reference hand-codes in pandas / DuckDB.

Design rules used throughout:

* "first row per key" is decided inside (key, hash bucket) first, then among the few
  survivors, so a key holding a third of all rows is not sorted in a single task.
* nothing is collected to the driver; every helper returns a lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def nulls_last(c) -> Column:
    """Ascending sort key with nulls after every value (pandas default)."""
    c = _col(c)
    return F.struct(c.isNull().alias("n"), c.alias("v"))


def sort_key(order: Sequence) -> Column:
    """One ascending, nulls-last struct over several order columns: a flat
    (is-null, value, is-null, value, ...) struct, which compares faster than
    nested structs."""
    fields = []
    for i, o in enumerate(order):
        c = _col(o)
        fields += [c.isNull().alias(f"n{i}"), c.alias(f"v{i}")]
    return F.struct(*fields)


# --------------------------------------------------------------------------- D13
HOT_ROWS = 100_000       # rows that a hash bin of cluster keys may send to one task unreduced
HOT_BINS = 1 << 16


def dedup_first(df: DataFrame, keys, order_by: Sequence,
                buckets: int = 16, cluster_by: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row per ``keys`` by ``order_by`` (ascending, nulls last).

    ``order_by`` should end with a unique column so the pick is deterministic.
    For a descending key pass an ascending expression (``-x`` or a ``when``).

    Two-phase top-1. Rows are first ranked inside
    (keys, hash bucket of the order values), so a key holding a third of all
    rows is split over ``buckets`` tasks; the bucket winners (at most
    ``buckets`` per key) are ranked again per key. Exact, codegen'd sorts.

    ``cluster_by`` (a subset of ``keys``): the result is hash-partitioned on these
    columns only, so that a following aggregate whose keys include them needs no further
    shuffle. Rows move there at once; phase 1 is for the hash bins of ``cluster_by`` that
    hold more than HOT_ROWS rows (counted first, at most HOT_BINS numbers a task).
    """
    keys = _names(keys)
    order = [_col(o).asc_nulls_last() for o in order_by]
    salt = F.pmod(F.xxhash64(*[_col(o) for o in order_by]), F.lit(buckets))
    w1 = Window.partitionBy(*keys, "__b").orderBy(*order)

    def bucket_winners(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("__b", salt).withColumn("__r", F.row_number().over(w1))
                .filter(F.col("__r") == 1).drop("__b", "__r"))

    if cluster_by:
        if not set(cluster_by) <= set(keys):
            raise ValueError("cluster_by must be a subset of keys")
        binned = F.pmod(F.xxhash64(*cluster_by), F.lit(HOT_BINS))
        hot = F.broadcast(df.groupBy(binned.alias("__bin")).agg(F.count(F.lit(1)).alias("__n"))
                          .filter(F.col("__n") > HOT_ROWS).select("__bin"))
        rows = df.withColumn("__bin", binned)
        cold, many = (rows.join(hot, "__bin", how).drop("__bin") for how in ("left_anti", "left_semi"))
        first = cold.unionByName(bucket_winners(many)).repartition(*cluster_by)
    else:
        first = bucket_winners(df)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return (first.withColumn("__r", F.row_number().over(w2)).filter(F.col("__r") == 1)
            .drop("__r"))


# --------------------------------------------------------------------------- B3/D4
def group_all_but(df: DataFrame, excluded: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Group by every column except ``excluded`` (null keys kept, like
    ``dropna=False``)."""
    keys = [c for c in df.columns if c not in set(excluded)]
    return df.groupBy(*keys).agg(*aggs)


# --------------------------------------------------------------------------- E1/L1
def running_total(df: DataFrame, by, order, value, out: str = "running_total") -> DataFrame:
    """Running sum per ``by`` ordered by ``order``. Default frame (RANGE
    unbounded preceding .. current row): peers of the current order value are
    included, as in SQL. Feed it pre-aggregated rows (see
    :func:`cumulative_counts`) so a partition holds one row per order value."""
    w = Window.partitionBy(*_names(by)).orderBy(_col(order))
    return df.withColumn(out, F.sum(_col(value)).over(w))


def cumulative_counts(df: DataFrame, by, time: str, counted: str,
                      out: str = "running_total") -> DataFrame:
    """Non-null ``counted`` per (by, time), then the running sum over time.

    The first step is a partial+final hash aggregate, so the window only sees
    one row per (key, time): its partitions are bounded by the number of
    distinct times, not by the raw row count of a hot key.
    """
    by = _names(by)
    per_time = df.groupBy(*by, time).agg(F.count(_col(counted)).alias("__n"))
    w = Window.partitionBy(by[0]).orderBy(F.col(time))
    return per_time.withColumn(out, F.sum("__n").over(w)).drop("__n")


def cohort_total(df: DataFrame, by, value, out: str) -> DataFrame:
    """Partition total on every row (``sum(v) over (partition by ..)``).

    Computed as a partial+final aggregate joined back on the cohort key rather
    than a window: a window would place a whole hot cohort in one task, while
    the aggregate combines map-side and the per-cohort table is small enough
    for AQE to broadcast (its size is measured at runtime, not assumed)."""
    by = _names(by)
    tot = df.groupBy(*by).agg(F.sum(_col(value)).alias(out))
    return df.join(tot, by, "left")


def cohort_share(df: DataFrame, by, value, out: str) -> DataFrame:
    """Row value divided by its partition total; null for an all-zero cohort."""
    by = _names(by)
    tot = df.groupBy(*by).agg(F.sum(_col(value)).alias("__tot"))
    return (df.join(tot, by, "left")
            .withColumn(out, F.try_divide(_col(value).cast("double"), F.col("__tot")))
            .drop("__tot"))


# --------------------------------------------------------------------------- C6
def asof_join(left: DataFrame, right: DataFrame, by, left_time: str, right_time: str,
              value, strict: bool = True, default=None, method: str = "join") -> DataFrame:
    """Attach to each left row the ``value`` columns of the latest right row of
    the same ``by`` key whose ``right_time`` is before ``left_time`` (``<`` when
    ``strict``, else ``<=``); ``default`` fills rows with no earlier match.

    ``method='join'``: distinct left (by, time) keys are equi-joined to the
    right rows with a residual time predicate and reduced with ``max_by``
    (partial aggregation), then joined back; best when each key has a bounded
    number of right rows (e.g. one per year).
    ``method='scan'``: both sides are sorted together in ranges and the last value is
    carried on, over the borders of ranges too (:func:`wreath.operators.ranges.asof_scan`):
    no fan-out and no task with all rows of a key, so it suits long histories and hot keys.
    ``method='history'``: the right rows of a key are one sorted list, which meets the left rows in one join
    on ``by``; left rows move once and stay partitioned by it. For many left rows and few right ones a key.
    """
    by = _names(by)
    values = _names(value)
    if method == "history":
        before = (lambda h: h["t"] < F.col(left_time)) if strict else (lambda h: h["t"] <= F.col(left_time))
        entry = F.struct(F.col(right_time).alias("t"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
        lists = right.filter(F.col(right_time).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_set(entry)).alias("__h"))
        last = F.try_element_at(F.filter("__h", before), F.lit(-1))
        out = left.join(lists, by, "left").select(*left.columns, last.alias("__last"))
        out = out.select(*left.columns, *[F.col("__last")[f"v{i}"].alias(v) for i, v in enumerate(values)])
        return out if default is None else out.fillna({v: default for v in values})
    keys = left.select(*by, F.col(left_time).alias("__t")).distinct()
    if method == "join":
        r = right.select(*[F.col(b).alias(f"__r_{b}") for b in by],
                         F.col(right_time).alias("__rt"),
                         *[F.col(v).alias(f"__v_{v}") for v in values])
        cond = [keys[b] == r[f"__r_{b}"] for b in by]
        cond.append(r["__rt"] < keys["__t"] if strict else r["__rt"] <= keys["__t"])
        best = F.max_by(F.struct(*[F.col(f"__v_{v}").alias(v) for v in values]),
                        F.col("__rt"))
        found = (keys.join(r, cond, "inner")
                 .groupBy(*[keys[b] for b in by], keys["__t"]).agg(best.alias("__best"))
                 .select(*by, "__t", *[F.col("__best")[v].alias(v) for v in values]))
    elif method == "scan":
        from wreath.operators.ranges import asof_scan

        out = asof_scan(left, right, by, left_time, right_time, values, strict)
        return out if default is None else out.fillna({v: default for v in values})
    else:
        raise ValueError(method)
    out = left.join(found.withColumnRenamed("__t", left_time), [*by, left_time], "left")
    if default is not None:
        out = out.fillna({v: default for v in values})
    return out


# --------------------------------------------------------------------------- C9
def fill_join(primary: DataFrame, fallback: DataFrame, on) -> DataFrame:
    """pandas ``combine_first``: keys of both sides, primary values win, the
    fallback fills primary nulls and adds missing keys."""
    on = _names(on)
    p, f = primary.alias("__p"), fallback.alias("__f")
    cols = list(dict.fromkeys([*primary.columns, *fallback.columns]))
    sel = []
    for c in cols:
        if c in on:
            sel.append(F.coalesce(F.col(f"__p.{c}"), F.col(f"__f.{c}")).alias(c))
        elif c in primary.columns and c in fallback.columns:
            sel.append(F.coalesce(F.col(f"__p.{c}"), F.col(f"__f.{c}")).alias(c))
        elif c in primary.columns:
            sel.append(F.col(f"__p.{c}").alias(c))
        else:
            sel.append(F.col(f"__f.{c}").alias(c))
    cond = [F.col(f"__p.{k}") == F.col(f"__f.{k}") for k in on]
    return p.join(f, cond, "full").select(*sel)


# --------------------------------------------------------------------------- E3/J27
def first_tier(tiers: Sequence[DataFrame], key, value: str, pos: str | None = None,
               nonempty: Sequence[bool] | None = None) -> DataFrame:
    """First answer per ``key`` across tiers in priority order.

    Each tier is (key, [pos], value). Rows with a null value never win; a tier
    flagged in ``nonempty`` also skips empty strings (truthiness). Inside a
    tier the smallest ``pos`` wins. One union, one partial aggregate.
    """
    key = _names(key)
    parts = []
    for i, t in enumerate(tiers):
        cond = F.col(value).isNotNull()
        if nonempty and nonempty[i]:
            cond = cond & (F.length(value) > 0)
        parts.append(t.filter(cond).select(
            *key, F.lit(i).alias("__tier"),
            (F.col(pos) if pos and pos in t.columns else F.lit(None).cast("long")).alias("__pos"),
            F.col(value)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(*key).agg(
        F.min_by(F.struct("__tier", F.col(value)), F.struct("__tier", "__pos", F.col(value)))
        .alias("__b")).select(*key, F.col("__b.__tier").alias("tier"), F.col(f"__b.{value}").alias(value))


# --------------------------------------------------------------------------- H5
def densify(df: DataFrame, keys, axis: str, lo: int, hi: int, value: str, fill=0) -> DataFrame:
    """Give every key every ``axis`` value in [lo, hi]; missing ones get ``fill``.

    The grid is built by exploding a fixed ``sequence`` on the distinct keys
    (a generator, not a cross join), then left-joined on (keys, axis)."""
    keys = _names(keys)
    grid = df.select(*keys).distinct().withColumn(axis, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return (grid.join(df.select(*keys, axis, value), [*keys, axis], "left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(fill))))


# --------------------------------------------------------------------------- H2
def explode_zip(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Explode equal-length list columns together; empty/null lists give one
    row of nulls (``explode_outer``)."""
    others = [c for c in df.columns if c not in cols]
    z = F.explode_outer(F.arrays_zip(*[F.col(c) for c in cols])).alias("__z")
    return df.select(*others, z).select(*others, *[F.col("__z")[c].alias(c) for c in cols])


# --------------------------------------------------------------------------- H7
def calendar_grid(years: DataFrame, year_col: str = "year", months=(1, 12)) -> DataFrame:
    """Every (year, month) for the distinct years of ``years``."""
    return (years.select(year_col).distinct()
            .withColumn("month", F.explode(F.sequence(F.lit(months[0]), F.lit(months[1])))))


# --------------------------------------------------------------------------- G4
def temporal_split(df: DataFrame, col: str, train: tuple, test: tuple) -> tuple[DataFrame, DataFrame]:
    """Two half-open range filters over one plan: [lo, hi)."""
    c = F.col(col)
    return (df.filter((c >= train[0]) & (c < train[1])),
            df.filter((c >= test[0]) & (c < test[1])))


# --------------------------------------------------------------------------- C7/G3
BLOCK_PARTS = 16
SLICE_ROWS = 2_048


def blocked_pairs(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column,
                  suffixes=("_l", "_r")) -> DataFrame:
    """Candidate pairs across two sets only (never within one), blocked on an
    equality of two expressions, e.g. ``l.year = r.year - 1``. The expressions
    become plain hash-join keys, so no cross product is formed.

    Two small sides can have a huge number of pairs, which Spark, going by the sides' bytes,
    would form in one task. So the left rows of a block are spread over ``BLOCK_PARTS`` parts and the right ones
    over slices of ``SLICE_ROWS``; left rows are copied to each slice, right ones to each part, and
    (block, part, slice) is partitioned by number. A task holds a slice at a time, however large the block. The right rows
    of a result repeat with each left row, so soon and in so even steps (a file packs numbers eight at a time) that a
    compressed file stores them about once."""
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism
    cell = ["__bk", "__part", "__slice"]

    def each(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    def bucket(df):
        return F.pmod(F.xxhash64(*df.columns), F.lit(BLOCK_PARTS)).cast("int")

    # rows of a block are numbered through BLOCK_PARTS buckets: no block is sorted by one task
    block = Window.partitionBy("__bk")
    before = F.sum("__n").over(block.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    counts = (right.select(right_key.alias("__bk"), bucket(right).alias("__of")).where(F.col("__bk").isNotNull())
              .groupBy("__bk", "__of").agg(F.count(F.lit(1)).alias("__n"))
              .select("__bk", "__of", F.coalesce(before, F.lit(0)).alias("__before"), F.ceil(F.sum("__n").over(block) / SLICE_ROWS).cast("int").alias("__slices")))
    slices = counts.groupBy("__bk").agg(F.max("__slices").alias("__slices"))
    l = left.select(*[F.col(c).alias(c + suffixes[0]) for c in left.columns], left_key.alias("__bk"), bucket(left).alias("__part"))
    l = l.join(slices, "__bk").withColumn("__slice", each(F.col("__slices"))).drop("__slices").repartition(tasks, *cell)
    r = right.select(*[F.col(c).alias(c + suffixes[1]) for c in right.columns], right_key.alias("__bk"), bucket(right).alias("__of"),
                     F.xxhash64(*right.columns).alias("__hash"))
    nth = F.row_number().over(Window.partitionBy("__bk", "__of").orderBy("__hash")) - 1
    r = r.withColumn("__nth", nth).join(counts, ["__bk", "__of"])
    r = r.withColumn("__slice", F.floor((F.col("__before") + F.col("__nth")) / SLICE_ROWS).cast("int")).drop("__of", "__hash", "__nth", "__before", "__slices")
    r = r.withColumn("__part", each(F.lit(BLOCK_PARTS))).repartition(tasks, *cell)
    return l.join(r, cell, "inner").drop(*cell)


# --------------------------------------------------------------------------- top-k per group
def top_n(df: DataFrame, by, order: str, tie: str, n, buckets: int = 16) -> DataFrame:
    """Rows with the ``n`` smallest (order, tie) per ``by`` group; ``n`` is an
    int or a column name. Two phases: top n inside each (group, hash bucket
    of ``tie``), then top n of the survivors, which is exact and sorts at
    most 1/``buckets`` of a hot group in one task."""
    by = _names(by)
    nn = F.lit(n) if isinstance(n, int) else F.col(n)
    w1 = Window.partitionBy(*by, "__b").orderBy(F.col(order), F.col(tie))
    first = (df.withColumn("__b", F.pmod(F.xxhash64(F.col(tie)), F.lit(buckets)))
             .withColumn("__r", F.row_number().over(w1)).filter(F.col("__r") <= nn))
    w2 = Window.partitionBy(*by).orderBy(F.col(order), F.col(tie))
    return (first.withColumn("__r", F.row_number().over(w2)).filter(F.col("__r") <= nn)
            .drop("__b", "__r"))
