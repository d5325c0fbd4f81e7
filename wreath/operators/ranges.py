"""Ordered work on hot groups: sorted ranges instead of one group in one task.

``asof_scan`` carries the last value along sorted ranges and over their borders;
``select_ranks`` finds the values at given ranks by counting digits, from the highest
on, so no task ever holds or sorts a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wreath.session import materialize


def group_key(by: Sequence[str]) -> Column:
    """One string for the values of several columns; equal for equal values, nulls included."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")


# --------------------------------------------------------------------------- C6
def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range with the last right value of their key in it. ``open``: no
    value yet and the key may have begun in an earlier range; the range's last key and value come last."""
    from pyspark import TaskContext

    part, first, key, value = TaskContext.get().partitionId(), None, None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.array(batch["key"].to_pylist(), object)
        right = batch["right"].to_numpy(zero_copy_only=False)
        if value is None:
            value = pa.nulls(1, batch["value"].type)
        starts = np.r_[keys[0] != key, keys[1:] != keys[:-1]]
        first = keys[0] if first is None else first
        values = pa.concat_arrays([value, batch["value"]])        # entry 0: what came before this batch
        if keys[0] != key:
            held = 0
        else:
            held = 1
        at = np.arange(1, n + 1)
        last = np.maximum.accumulate(np.where(right, at, 0))
        begin = np.maximum.accumulate(np.where(starts, at, 0))       # 0 while the batch before goes on
        found = last >= np.maximum(begin, 1)
        carried = (begin == 0) & ~found & (held == 1) & value.is_valid()[0].as_py()
        take = pa.array(np.where(found, last, 0), mask=~(found | carried))
        left = ~right
        given = values.take(take)
        opened = ~(found | carried) & (keys == first)
        key = keys[-1]
        value = given.slice(n - 1, 1) if (found | carried)[-1] else pa.nulls(1, batch["value"].type)
        if left.any():
            pick = pa.array(np.flatnonzero(left))
            m = int(left.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, part, np.int64)), pa.array(keys[left], pa.string()), batch["row"].take(pick), given.take(pick),
                 pa.array(opened[left]), pa.nulls(m, pa.bool_())], ["part", "key", "row", "value", "open", "whole"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([key], pa.string()), pa.nulls(1, batch["row"].type), value,
                                          pa.nulls(1, pa.bool_()), pa.array([first == key])], ["part", "key", "row", "value", "open", "whole"])


def asof_scan(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str],
              strict: bool = True, ) -> DataFrame:
    """``left`` with the ``values`` of the latest right row of the same ``by`` before ``left_time`` (``strict``) or not after it.

    Both sides are sorted together by (key, time) in ranges; a range carries its last value on, and the last
    value of each range (one row a range on the driver) goes on into the next. A key with half of all rows spreads over as
    many ranges as its rows fill. Of right rows with equal times the largest values count. Rows with a null key or time match nothing."""
    spark = left.sparkSession
    row, value = F.struct(*[F.col(c) for c in left.columns]), F.struct(*[F.col(v) for v in values])
    known = F.lit(True)
    for b in by:
        known = known & F.col(b).isNotNull()
    l = left.select(F.when(known, group_key(by)).otherwise(F.lit("")).alias("key"), F.when(known, F.col(left_time)).alias("time"),
                    F.lit(False).alias("right"), F.struct(row.alias("r")).alias("row"), F.lit(None).alias("value"), F.monotonically_increasing_id().alias("tie"))
    r = right.where(known & F.col(right_time).isNotNull()).select(
        group_key(by).alias("key"), F.col(right_time).alias("time"), F.lit(True).alias("right"), F.lit(None).alias("row"),
        value.alias("value"), F.lit(0).cast("long").alias("tie"))
    row_type, value_type = l.schema["row"].dataType, r.schema["value"].dataType
    both = l.withColumn("value", F.lit(None).cast(value_type)).unionByName(r.withColumn("row", F.lit(None).cast(row_type)))
    side = F.when(F.col("right"), F.lit(1 if strict else 0)).otherwise(F.lit(0 if strict else 1))
    order = ["key", "time", side, *[F.col("value")[v] for v in values], "tie"]
    spread = both.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "right", "row", "value")
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("key", T.StringType()), T.StructField("row", row_type),
                           T.StructField("value", value_type), T.StructField("open", T.BooleanType()), T.StructField("whole", T.BooleanType())])
    scanned = materialize(spread.mapInArrow(_carry, schema))
    carried, key, last = [], None, None
    for e in scanned.where("whole is not null").orderBy("part").select("part", "key", "value", "whole").collect():
        if last is not None:
            carried.append((e["part"], key, last))
        goes_on = e["whole"] and e["key"] == key
        last = e["value"] if e["value"] is not None else (last if goes_on else None)
        key = e["key"]
    before = spark.createDataFrame(carried, T.StructType([T.StructField("part", T.LongType()), T.StructField("key", T.StringType()),
                                                          T.StructField("before", value_type)]))
    out = scanned.where("whole is null").join(F.broadcast(before), ["part", "key"], "left")       # a row a range at most
    given = F.when(F.col("open"), F.coalesce("value", "before")).otherwise(F.col("value"))
    return out.select("row.r", given.alias("value")).select("r.*", *[F.col("value")[v].alias(v) for v in values])


# --------------------------------------------------------------------------- D6 / D18 / E6
DIGIT = 16        # bits of a key that one round counts
SORT_ROWS = 100_000      # rows of a group, or of one with a common prefix, that a task may sort


def _ordered_bits(x: pa.Array) -> pa.Array:
    v = x.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0      # -0.0 counts as 0.0
    bits = v.view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits))


def _from_bits(k: pa.Array) -> pa.Array:
    bits = k.to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits).view(np.float64))


def double_key(x: Column) -> Column:
    """A whole number that orders like the double ``x`` (NaN last, as in Spark); null stays null."""
    return F.when(x.isNotNull(), F.arrow_udf(_ordered_bits, T.LongType())(F.coalesce(x.cast("double"), F.lit(0.0))))


def key_double(k: Column) -> Column:
    return F.when(k.isNotNull(), F.arrow_udf(_from_bits, T.DoubleType())(F.coalesce(k, F.lit(0).cast("long"))))


def select_ranks(data: DataFrame, targets: DataFrame, largest: int, sort_rows: int | None = None) -> DataFrame:
    """(g, rank, key): the key at each ``rank`` (from 0, ascending) of group ``g``; ``data`` is a stored (g, key long),
    ``targets`` (g, rank long), ``largest`` the rows of the largest group. Ranks beyond a group's rows are left out.

    Rounds of counting: keys by their next 16 bits, within the prefixes that still hold a wanted rank. A round's table has
    at most 65,536 rows a prefix and is summed up before it is shuffled. As soon as no wanted prefix has more than
    ``sort_rows`` rows, these are sorted; after four rounds all of a prefix are equal."""
    sort_rows = SORT_ROWS if sort_rows is None else sort_rows
    wanted = targets.select("g", "rank", F.lit(0).cast("long").alias("prefix"), F.col("rank").alias("left"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        top = shift == 64 - DIGIT
        rows = data.select("g", (F.lit(0).cast("long") if top else F.shiftright("key", shift + DIGIT)).alias("prefix"), "key")
        if not top:
            rows = rows.join(wanted.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
        if largest <= sort_rows:
            order = F.row_number().over(Window.partitionBy("g", "prefix").orderBy("key")) - 1
            placed = rows.withColumn("left", order.cast("long"))
            return wanted.join(placed, ["g", "prefix", "left"]).select("g", "rank", "key")
        digit = F.shiftright("key", shift) if top else F.shiftright("key", shift).bitwiseAND((1 << DIGIT) - 1)
        counted = rows.groupBy("g", "prefix", digit.alias("digit")).agg(F.count("*").alias("n"))
        counted = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("g", "prefix").orderBy("digit")))
        hit = (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n"))
        wanted = materialize(wanted.join(counted, ["g", "prefix"]).where(hit).select(
            "g", "rank", (F.col("digit") if top else F.col("prefix") * (1 << DIGIT) + F.col("digit")).alias("prefix"),
            (F.col("left") - F.col("upto") + F.col("n")).alias("left"), "n"))
        largest = wanted.agg(F.max("n")).first()[0] or 0
        wanted = wanted.drop("n")
    return wanted.select("g", "rank", F.col("prefix").alias("key"))


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, quantiles: Sequence[float]) -> DataFrame:
    """(by..., q0, q1, ...): quantiles of ``col`` in each group, linear between neighbours, exact whatever a group's size.
    Groups without a value have nulls."""
    by = list(by)
    same = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    data = materialize(df.select(group_key(by).alias("g"), same.alias("by"), double_key(F.col(col)).alias("key")))
    groups = materialize(data.groupBy("g", "by").agg(F.count("key").alias("n")))
    at = [F.lit(float(q)) * (F.col("n") - 1) for q in quantiles]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in at for f in (F.floor, F.ceil)]))
    values = data.where("key is not null").select("g", "key")
    largest = groups.agg(F.max("n")).first()[0] or 0
    found = select_ranks(values, groups.where("n > 0").select("g", F.explode(ranks).alias("rank")), largest)
    held = found.withColumn("x", key_double(F.col("key"))).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("m"))
    joined = groups.join(held, "g", "left")
    out = []
    for i, p in enumerate(at):
        lo, hi = F.try_element_at("m", F.floor(p).cast("long")), F.try_element_at("m", F.ceil(p).cast("long"))
        part = p - F.floor(p)
        out.append(F.when(part == 0, lo).otherwise(lo + (hi - lo) * part).alias(f"q{i}"))
    return joined.select(*[F.col("by")[b].alias(b) for b in by], *out)


def top_flags(df: DataFrame, by: Sequence[str], score: str, n_col: str, tie: str, out: str) -> DataFrame:
    """``df`` with ``out`` = 1 for the first ``n_col`` rows of each group by ``score`` descending (nulls last) and ``tie`` ascending, else 0.

    The cut-off score of a group is found by its rank, then the cut-off ``tie`` among the rows with that score; every row is
    compared with the two, none is ranked. ``n_col`` is constant in a group; ``tie`` is a number that tells the group's rows apart."""
    by = list(by)
    lowest = F.lit(-(1 << 63)).cast("long")
    # largest score first: the complement of the ordered key; nulls after all
    down = F.coalesce(F.bitwise_not(double_key(F.col(score))), F.lit((1 << 63) - 1).cast("long"))
    whole = dict(df.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint")
    tied = F.col(tie).cast("long") if whole else F.coalesce(double_key(F.col(tie)), lowest)
    keyed = df.select("*", group_key(by).alias("__g"), down.alias("__down"), F.coalesce(tied, lowest).alias("__tie"))
    data = materialize(keyed.select(F.col("__g").alias("g"), F.col("__down").alias("key"), F.col("__tie").alias("tie"), F.col(n_col).cast("long").alias("n")))
    groups = materialize(data.groupBy("g").agg(F.max("n").alias("n"), F.count("*").alias("rows")))
    largest = groups.agg(F.max("rows")).first()[0] or 0
    cut = materialize(select_ranks(data.select("g", "key"), groups.where("n > 0 and n < rows").select("g", (F.col("n") - 1).alias("rank")), largest)
                      .select("g", F.col("key").alias("cut")))
    met = data.join(cut, "g")
    above = met.where("key < cut").groupBy("g").agg(F.count("*").alias("above"))
    left = cut.join(groups, "g").join(above, "g", "left").select("g", "cut", (F.col("n") - F.coalesce("above", F.lit(0)) - 1).alias("rank"))
    ties = materialize(met.where("key = cut").select("g", F.col("tie").alias("key")))
    most = largest if largest <= SORT_ROWS else ties.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    edge = select_ranks(ties, left.select("g", "rank"), most).select("g", F.col("key").alias("edge"))
    limits = groups.join(cut, "g", "left").join(edge, "g", "left").select(F.col("g").alias("__g"), (F.col("n") >= F.col("rows")).alias("__all"), "cut", "edge")
    limits = limits.withColumnsRenamed({"cut": "__cut", "edge": "__edge"})
    wins = F.col("__all") | (F.col("__down") < F.col("__cut")) | ((F.col("__down") == F.col("__cut")) & (F.col("__tie") <= F.col("__edge")))
    return keyed.join(limits, "__g", "left").withColumn(out, F.when(wins, 1).otherwise(0)).select(*df.columns, out)
