"""Nearest-neighbour mutual information of numeric columns (Kraskov, Stoegbauer and Grassberger 2004).

For each row the distance to its ``k``-th neighbour in the plane (feature, target), the larger of the two
differences, and the numbers of rows nearer than that in either column alone; digammas of these numbers give the estimate.

Both columns are divided by their standard deviation and turned into whole numbers (steps of 2**-44, or wider where
a value lies beyond 2**16 deviations), so all distances are exact. Equal values are told apart by a shift of up to 2**19 steps
either way, drawn by a hash of the row's id: the result depends neither on the machine nor on partitions.

Neighbours: rows are range-partitioned along a Z-order curve of the plane (128 bits, so rows that agree in one column
still spread over tasks), each range searches its own rows, and a row whose search square reaches into another range's box is
sent there as well. Numbers of nearer rows are differences of running counts along sorted ranges. What comes to the
driver is one row a range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wreath.session import materialize, ship_package

STEP_BITS = 44
JITTER_HEX = 5            # hexadecimal digits of the hash: shifts of -2**19 to 2**19 - 1 steps
BLOCK = 256               # rows that the search inside a range takes together
FAR = np.iinfo(np.int64).max


def digamma(n: Column) -> Column:
    """Digamma of a whole number from 1, by its asymptotic series eight further on."""
    m = n.cast("double") + 8
    series = F.log(m) - 1 / (2 * m) - 1 / (12 * m ** 2) + 1 / (120 * m ** 4) - 1 / (252 * m ** 6) + 1 / (240 * m ** 8) - 1 / (132 * m ** 10)
    for j in range(8):
        series = series - 1 / (n + F.lit(float(j)))
    return series


def steps_of(col: str, row_id: str, deviation: float, bits: int) -> Column:
    """``col`` as a whole number of steps, shifted by the hash of the row's id and the column's name."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.col(row_id).cast("string"), F.lit(":" + col)).cast("binary")), 1, JITTER_HEX), 16, 10).cast("long")
    scaled = F.floor(F.col(col).cast("double") / F.lit(deviation) * F.lit(float(1 << bits)))
    return scaled.cast("long") + drawn - F.lit(1 << (4 * JITTER_HEX - 1))


# --------------------------------------------------------------------------- Z-order
def _interleave(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The 32 low bits of two arrays, alternating, as one signed key each that orders like the unsigned number."""
    out = []
    for v in (x, y):
        v = v.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = (v | v << np.uint64(shift)) & np.uint64(mask)
        out.append(v)
    return ((out[0] << np.uint64(1) | out[1]) ^ np.uint64(1 << 63)).view(np.int64)


def _keys(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, v = (c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in (x, y))
    return _interleave(u >> np.uint64(32), v >> np.uint64(32)), _interleave(u, v)


def _curve():
    @F.arrow_udf("struct<high:long,low:long>")
    def key(x: pa.Array, y: pa.Array) -> pa.Array:
        keys = _keys(x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(k) for k in keys], ["high", "low"])

    return key


def _along(rows: pa.Table) -> pa.Table:
    """Rows in the order of the curve, as :func:`nearest` needs them to find small boxes."""
    return rows.take(pa.array(np.lexsort(_keys(rows["x"].to_numpy(), rows["y"].to_numpy())[::-1])))


# --------------------------------------------------------------------------- neighbours
def _boxes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(least x, largest x, least y, largest y) of every BLOCK rows."""
    at = np.arange(0, len(x), BLOCK)
    return np.stack([f.reduceat(v, at) for v in (x, y) for f in (np.minimum, np.maximum)], 1)


def _gap(box: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of points from boxes (0 inside); broadcasts."""
    return np.maximum(np.maximum(box[..., 0] - x, x - box[..., 1]), np.maximum(np.maximum(box[..., 2] - y, y - box[..., 3]), 0))


def nearest(qx: np.ndarray, qy: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, near: np.ndarray | None = None, own: bool = False) -> np.ndarray:
    """The ``k`` least distances (FAR where there are fewer) of each query from the rows, ``near`` included; both in curve order.
    ``own``: the queries are the rows, and none is its own neighbour."""
    near = np.full((len(qx), k), FAR) if near is None else near.copy()
    if not len(x) or not len(qx):
        return near
    boxes, asking = _boxes(x, y), _boxes(qx, qy)
    for b, (x0, x1, y0, y1) in enumerate(asking):
        rows = np.arange(b * BLOCK, min(len(qx), (b + 1) * BLOCK))
        apart = np.maximum(np.maximum(boxes[:, 0] - x1, x0 - boxes[:, 1]), np.maximum(np.maximum(boxes[:, 2] - y1, y0 - boxes[:, 3]), 0))
        for at in np.argsort(apart, kind="stable"):
            worst = near[rows, -1]
            if apart[at] >= worst.max():
                break
            ask = rows[_gap(boxes[at], qx[rows], qy[rows]) < worst]
            if not len(ask):
                continue
            there = np.arange(at * BLOCK, min(len(x), (at + 1) * BLOCK))
            d = np.maximum(np.abs(qx[ask, None] - x[there]), np.abs(qy[ask, None] - y[there]))
            if own and at == b:
                d[ask[:, None] == there] = FAR
            both = np.concatenate([near[ask], d], 1)
            near[ask] = np.sort(np.partition(both, k - 1, 1)[:, :k], 1)
    return near


def _lists(near: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))


def neighbour_distances(points: DataFrame, k: int) -> DataFrame:
    """(row, x, y, reach): for every (row long, x long, y long) the distance to its ``k``-th neighbour; FAR if there are fewer."""
    spark = points.sparkSession
    ship_package(spark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches), pa.schema([("row", pa.int64()), ("x", pa.int64()), ("y", pa.int64())]))
        if table.num_rows:
            row, x, y = (table[c].to_numpy() for c in ("row", "x", "y"))
            part = pa.array(np.full(len(row), TaskContext.get().partitionId(), np.int64))
            yield pa.RecordBatch.from_arrays([part, pa.array(row), pa.array(x), pa.array(y), _lists(nearest(x, y, x, y, k, own=True))],
                                             ["part", "row", "x", "y", "near"])

    curve = points.withColumn("z", _curve()("x", "y")).select("row", "x", "y", "z.high", "z.low")
    order = ["high", "low", "row"]
    spread = curve.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "x", "y")
    local = materialize(spread.mapInArrow(search, "part long, row long, x long, y long, near array<long>"))
    ranges = local.groupBy("part").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).orderBy("part").collect()
    number = np.array([r[0] for r in ranges], np.int64)
    boxes = np.array([tuple(r)[1:] for r in ranges], np.int64).reshape(-1, 4)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose search square meets another range's box, once for each such range."""
        for batch in batches:
            part, row, x, y = (batch[c].to_numpy(zero_copy_only=False) for c in ("part", "row", "x", "y"))
            near = batch["near"].flatten().to_numpy().reshape(-1, k)
            for i in range(0, batch.num_rows, BLOCK):
                s = slice(i, i + BLOCK)
                x0, x1, y0, y1 = x[s].min(), x[s].max(), y[s].min(), y[s].max()
                apart = np.maximum(np.maximum(boxes[:, 0] - x1, x0 - boxes[:, 1]), np.maximum(np.maximum(boxes[:, 2] - y1, y0 - boxes[:, 3]), 0))
                some = np.flatnonzero(apart < near[s, -1].max())
                meets = (_gap(boxes[some], x[s, None], y[s, None]) < near[s, -1:]) & (number[some] != part[s, None])
                a, b = np.nonzero(meets)
                if len(a):
                    a = a + i
                    yield pa.RecordBatch.from_arrays([pa.array(number[some][b]), pa.array(row[a]), pa.array(x[a]), pa.array(y[a]), _lists(near[a])],
                                                     ["part", "row", "x", "y", "near"])

    def ask(key: tuple[pa.Scalar, ...], here: pa.Table, there: pa.Table) -> pa.Table:
        here, there = _along(here), _along(there)      # a shuffle keeps no order
        row, qx, qy = (there[c].to_numpy() for c in ("row", "x", "y"))
        x, y = (here[c].to_numpy() for c in ("x", "y"))
        near = there["near"].combine_chunks().flatten().to_numpy().reshape(-1, k) if there.num_rows else np.zeros((0, k), np.int64)
        # only what this range adds goes back: the row's own list stays where it is
        found = nearest(qx, qy, x, y, k, np.repeat(near[:, -1:], k, 1))
        better = found[:, 0] < near[:, -1]
        return pa.table({"row": pa.array(row[better]), "more": _lists(found[better])})

    # the ranges are even, so a group is one range and the rows that reach into it
    halo = local.mapInArrow(reached, local.schema)
    more = (local.select("part", "x", "y").groupBy("part").cogroup(halo.groupBy("part")).applyInArrow(ask, "row long, more array<long>")
            .groupBy("row").agg(F.flatten(F.collect_list("more")).alias("more")))       # at most k a reached range
    added = F.array_sort(F.concat("near", "more"))
    # `more` is filled up with copies of the row's own worst distance, which come after all nearer ones
    reach = F.coalesce(F.element_at(added, k), F.element_at("near", k))
    return local.join(more, "row", "left").select("row", "x", "y", reach.alias("reach"))


# --------------------------------------------------------------------------- nearer rows in one column
def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions of a sorted range with the points before them in it; the range's points come last."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), 0
    names = ["part", "row", "sign", "n"]
    for batch in batches:
        sign = batch["sign"].to_numpy(zero_copy_only=False)
        upto = seen + np.cumsum(sign == 0)
        asks = sign != 0
        seen = int(upto[-1]) if len(upto) else seen
        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(asks.sum()), part, np.int64)), batch["row"].filter(pa.array(asks)),
                                          pa.array(sign[asks].astype(np.int32)), pa.array(upto[asks].astype(np.int64))], names)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.nulls(1, pa.int64()), pa.array([0], pa.int32()), pa.array([seen], pa.int64())], names)


def nearer_rows(reached: DataFrame, col: str) -> DataFrame:
    """(row, n): other rows whose ``col`` is nearer than ``reach`` (of equal value where ``reach`` is 0)."""
    inside = F.greatest(F.col("reach") - 1, F.lit(0))
    event = lambda value, sign: F.struct(value.alias("value"), F.lit(sign).alias("sign"))
    x = F.col(col)
    events = reached.select("row", F.explode(F.array(event(x - inside, -1), event(x, 0), event(x + inside, 1))).alias("e")).select("row", "e.*")
    # at one value: lower edges, points, upper edges
    spread = events.repartitionByRange("value", "sign", "row").sortWithinPartitions("value", "sign", "row").select("row", "sign")
    counted = materialize(spread.mapInArrow(_running, "part long, row long, sign int, n long"))
    before, total = [], 0
    for r in counted.where("row is null").orderBy("part").select("part", "n").collect():
        before.append((r["part"], total))
        total += r["n"]
    offsets = reached.sparkSession.createDataFrame(before, "part long, before long")
    known = counted.where("row is not null").join(F.broadcast(offsets), "part")         # one row a range
    return known.groupBy("row").agg((F.sum(F.col("sign") * (F.col("n") + F.col("before"))) - 1).alias("n"))


def nearest_mutual_information(df: DataFrame, features: Sequence[str], target: str, row_id: str, k: int = 3) -> DataFrame:
    """(feature, n, mi): mutual information in nats of each numeric feature with the numeric ``target``, at least 0.

    Rows with a null or NaN in one of the two, or a null id, are left out of that feature. A column with one value only has
    0; with ``k`` rows or fewer ``mi`` is null. ``row_id`` should tell rows apart: equal ids are shifted alike."""
    spark, out = df.sparkSession, []
    for feature in features:
        rows = df.select(*dict.fromkeys([row_id, feature, target]))
        for c in dict.fromkeys([feature, target]):
            rows = rows.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
        rows = rows.where(F.col(row_id).isNotNull())
        sizes = rows.agg(F.count("*").alias("n"), *[f(F.col(c).cast("double")).alias(f"{name}{i}") for i, c in enumerate((feature, target))
                                                    for name, f in (("sd", F.stddev_pop), ("least", F.min), ("most", F.max))]).first()
        if sizes["n"] <= k:
            out.append((feature, sizes["n"], None))
            continue
        if not all(sizes[f"least{i}"] < sizes[f"most{i}"] and sizes[f"sd{i}"] > 0 for i in (0, 1)):
            out.append((feature, sizes["n"], 0.0))
            continue
        largest = max(abs(sizes[f"{name}{i}"]) / sizes[f"sd{i}"] for i in (0, 1) for name in ("least", "most"))
        bits = min(STEP_BITS, 60 - max(0, math.ceil(math.log2(largest + 1))))
        points = materialize(rows.select(F.monotonically_increasing_id().alias("row"), steps_of(feature, row_id, sizes["sd0"], bits).alias("x"),
                                         steps_of(target, row_id, sizes["sd1"], bits).alias("y")))
        reached = materialize(neighbour_distances(points, k))
        counts = nearer_rows(reached, "x").unionByName(nearer_rows(reached, "y"))
        # few distinct numbers: the digammas are taken once each
        terms = counts.groupBy("n").agg(F.count("*").alias("rows")).agg(F.sum(F.col("rows") * digamma(F.col("n") + 1)).alias("s")).first()["s"]
        harmonic = spark.range(1).select(digamma(F.lit(sizes["n"])) + digamma(F.lit(k))).first()[0]
        out.append((feature, sizes["n"], max(0.0, harmonic - terms / sizes["n"])))
    return spark.createDataFrame(out, "feature string, n long, mi double")
