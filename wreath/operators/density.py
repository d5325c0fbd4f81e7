"""Topics by density: their number comes from the data, scattered vectors get none.

1. Neighbour graph. Vectors of a cohort are put into cells (signs of seeded random
   directions around the cohort's mean; a cohort that fits one cell has just that one,
   so its neighbours are exact). Within a cell blocks of rows are compared as
   matrices, and the k nearest of each vector are kept.
2. Density. A vector's core distance is that to its k-th neighbour. Every vector
   points to its densest neighbour if that is denser than itself; following the
   pointers (doubling them each round) ends at a peak, and the vectors of a peak are its basin.
3. Saddles. Two basins touch at the least mutual reachability (the largest of both
   core distances and the distance) of a link between them. A peak whose core distance is within
   ``prominence`` of its lowest saddle is no topic of its own: its basin joins the
   denser one across. Rounds of this end when nothing joins.
4. Noise. Vectors whose core distance exceeds ``spread`` times the median of their
   topic, and topics with fewer than ``min_size`` vectors, get the topic -1.

All steps compare densities only with those nearby, so topics may differ in density.
Equal vectors are compared once and carry their number. Every table grows at most with
vectors x k and stays distributed; only row counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wreath.session import materialize

CELL_ROWS = 2_000
TABLES = 6            # independent sets of cells for cohorts of more than one cell
NOISE = -1


def signs_udf(dim: int, bits_max: int, seed: int):
    """array<long>: for each table the signs of ``bits`` random directions."""
    turns = np.random.default_rng(seed).standard_normal((TABLES * bits_max, dim))

    def signs(vectors: pa.Array, bits: pa.Array) -> pa.Array:
        x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
        side = (x @ turns.T > 0).reshape(len(x), TABLES, bits_max)
        out = []
        for row, b in zip(side, bits.to_pylist()):
            codes = [int(sum(1 << i for i in range(b) if t[i])) for t in row]
            out.append(codes if b else codes[:1])
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(signs, T.ArrayType(T.LongType()))


def _nearest(k: int):
    """k nearest rows across two blocks of a cell (or within one)."""
    def nearest(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, block = group["id"].to_numpy(), group["block"].to_numpy()
        x = np.asarray(group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), -1)
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        found: list[tuple] = []
        for left, right in ([(a, b)] if lo == hi else [(a, b), (b, a)]):
            if not len(left) or not len(right):
                continue
            sq = (x[right] ** 2).sum(1)
            for at in range(0, len(left), 512):
                rows = left[at: at + 512]
                d = np.sqrt(np.maximum(0.0, (x[rows] ** 2).sum(1)[:, None] + sq[None, :] - 2 * x[rows] @ x[right].T))
                d[rows[:, None] == right[None, :]] = np.inf
                n = min(k, len(right))
                near = np.argpartition(d, n - 1, axis=1)[:, :n]
                dist = np.take_along_axis(d, near, 1)
                real = np.isfinite(dist)
                found.append((np.repeat(ids[rows], n)[real.ravel()], ids[right][near].ravel()[real.ravel()], dist.ravel()[real.ravel()]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"id": pa.array(cols[0], pa.int64()), "near": pa.array(cols[1], pa.int64()), "dist": pa.array(cols[2], pa.float64())})

    return nearest


def neighbours(points: DataFrame, k: int, dim: int, cell_rows: int = CELL_ROWS, seed: int = 0) -> DataFrame:
    """(id, near, dist): the k nearest of every vector of stored ``points`` (cohort, id, v) in its cohort."""
    sizes = points.groupBy("cohort").agg(F.count("*").alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / cell_rows))).cast("int")
    sizes = materialize(sizes.select("cohort", bits.alias("bits")))
    most = sizes.agg(F.max("bits")).first()[0] or 0
    if most:
        mean = points.select("cohort", F.posexplode("v").alias("i", "x")).groupBy("cohort", "i").agg(F.avg("x").alias("m"))
        mean = mean.groupBy("cohort").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
        centred = points.join(sizes, "cohort").join(mean, "cohort").withColumn("w", F.zip_with("v", "m", lambda a, b: a - b))
        coded = centred.select("cohort", "id", "v", F.posexplode(signs_udf(dim, most, seed)("w", "bits")).alias("t", "code"))
    else:
        coded = points.select("cohort", "id", "v", F.lit(0).alias("t"), F.lit(0).cast("long").alias("code"))
    cell = ["cohort", "t", "code"]
    # cells larger than meant are cut into blocks that meet each other pair by pair
    blocks = coded.groupBy(*cell).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("m"))
    cut = coded.join(blocks, cell).withColumn("block", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    met = cut.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(
        *cell, "id", "v", "block", F.least("block", "p").alias("lo"), F.greatest("block", "p").alias("hi"))
    pairs = met.groupBy(*cell, "lo", "hi").applyInArrow(_nearest(k), "id long, near long, dist double")
    best = pairs.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("dist", "near"))), 1, k).alias("best"))
    return best.select("id", F.explode("best").alias("b")).select("id", F.col("b.near").alias("near"), F.col("b.dist").alias("dist"))


def _followed(links: DataFrame) -> DataFrame:
    """(id, root): pointers (id, to) followed to their ends, twice as far each round."""
    now = materialize(links)
    while True:
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("further"))
        now = materialize(now.join(ahead, "to").select("id", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("id", F.col("to").alias("root"))
        now = now.drop("moved")


def _joined(basins: DataFrame, saddles: DataFrame, prominence: float) -> DataFrame:
    """(id, root): each peak with the one its basin ends in; ``basins`` (id, core), ``saddles`` (a, b, height)."""
    merged = basins.select("id", F.col("id").alias("root"))
    while True:
        core = basins.select(F.col("id").alias("b"), F.col("core").alias("core_b"))
        # the lowest saddle of each basin; the denser side across is joined when the peak hardly rises above it
        lowest = saddles.groupBy("a").agg(F.min(F.struct("height", "b")).alias("s")).select("a", "s.height", "s.b")
        dense = lowest.join(basins.select(F.col("id").alias("a"), "core"), "a").join(core, "b")
        ups = materialize(dense.where((F.struct("core_b", "b") < F.struct(F.col("core"), F.col("a"))) & (F.col("height") < prominence * F.col("core")))
                          .select(F.col("a").alias("id"), F.col("b").alias("to")))
        if ups.isEmpty():
            return merged
        links = ups.unionByName(basins.join(ups, "id", "left_anti").select("id", F.col("id").alias("to")))
        ends = _followed(links)
        merged = materialize(merged.join(ends.select(F.col("id").alias("root"), F.col("root").alias("end")), "root").select("id", F.col("end").alias("root")))
        basins = materialize(basins.join(ends.select("root").distinct().withColumnRenamed("root", "id"), "id", "left_semi"))
        a, b = ends.select(F.col("id").alias("a"), F.col("root").alias("ra")), ends.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        saddles = materialize(saddles.join(a, "a").join(b, "b").where("ra <> rb").groupBy(F.col("ra").alias("a"), F.col("rb").alias("b")).agg(
            F.min("height").alias("height")))


def density_topics(df: DataFrame, key: str, vec: str, by: Sequence[str] = (), min_size: int = 10, k: int | None = None,
                   prominence: float = 1.5, spread: float = 2.0, cell_rows: int = CELL_ROWS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Topics of each cohort. Returns (assignments: key, by..., topic; centroids: by..., topic, centroid, size).

    Topics are numbered from 0 by size within a cohort; -1: none. ``min_size``: vectors of the smallest topic;
    ``k``: neighbours that define density (``min_size`` when None). Null vectors get no row. Ties go to the smaller vector."""
    from wreath.operators.vectors import mean_vector, vector_dim

    by, k = list(by), k or min_size
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key).alias("__key"), F.struct(*([F.col(c) for c in by] or [F.lit(0).alias("all")])).alias("cohort"),
                                                   F.transform(vec, lambda x: x.cast("double")).alias("v"))
    rows = materialize(rows)
    dim = vector_dim(rows, "v")
    # equal vectors once; numbered in the order of their values, so ties do not depend on partitions
    distinct = rows.groupBy("cohort", "v").agg(F.count("*").alias("n"))
    points = materialize(distinct.select("cohort", "v", "n", F.xxhash64("cohort", "v").alias("h")).orderBy("h", "v").select(
        F.monotonically_increasing_id().alias("id"), "cohort", "v", "n"))
    near = materialize(neighbours(points.select("cohort", "id", "v"), k, dim, cell_rows, seed))
    core = materialize(near.groupBy("id").agg(F.max("dist").alias("core")))
    other = core.select(F.col("id").alias("near"), F.col("core").alias("near_core"))
    edges = materialize(near.join(core, "id").join(other, "near"))
    up = edges.groupBy("id", "core").agg(F.min(F.struct("near_core", "near")).alias("top"))
    points_up = up.select("id", F.when((F.col("top.near_core") < F.col("core")) | ((F.col("top.near_core") == F.col("core")) & (F.col("top.near") < F.col("id"))),
                                       F.col("top.near")).otherwise(F.col("id")).alias("to"))
    basin = _followed(points_up)
    a, b = basin.select("id", F.col("root").alias("a")), basin.select(F.col("id").alias("near"), F.col("root").alias("b"))
    crossing = edges.join(a, "id").join(b, "near").where("a <> b").select("a", "b", F.greatest("core", "near_core", "dist").alias("height"))
    both = crossing.unionByName(crossing.select(F.col("b").alias("a"), F.col("a").alias("b"), "height"))
    saddles = materialize(both.groupBy("a", "b").agg(F.min("height").alias("height")))
    peaks = materialize(basin.select("root").distinct().select(F.col("root").alias("id")).join(core, "id"))
    ends = _joined(peaks, saddles, prominence)
    placed = materialize(basin.join(ends.select(F.col("id").alias("root"), F.col("root").alias("end")), "root").join(core, "id").join(
        points.select("id", "n"), "id").select("id", "end", "core", "n"))
    middle = placed.groupBy("end").agg(F.percentile_approx("core", 0.5, 10_000).alias("middle"))
    inside = placed.join(middle, "end").where(F.col("core") <= spread * F.col("middle"))
    large = inside.groupBy("end").agg(F.sum("n").alias("size")).where(F.col("size") >= min_size)
    member = materialize(inside.join(large, "end").select("id", "end", "size"))
    named = points.select("id", "cohort", "v").join(member, "id", "left")
    # number of a topic: topics of its cohort that are larger (there are at most vectors / min_size)
    from pyspark.sql import Window
    order = Window.partitionBy("cohort").orderBy(F.col("size").desc(), "end")
    numbers = named.where("end is not null").select("cohort", "end", "size").distinct().withColumn("topic", (F.row_number().over(order) - 1).cast("int"))
    labelled = named.join(numbers.select("end", "topic"), "end", "left").select("cohort", "v", F.coalesce("topic", F.lit(NOISE)).alias("topic"))
    out = materialize(rows.join(labelled, ["cohort", "v"]).select(F.col("__key").alias(key), *[F.col("cohort")[c].alias(c) for c in by], "topic", "v"))
    # count is int64 in mean_vector's "size"
    centroids = mean_vector(out.where(F.col("topic") != NOISE), [*by, "topic"], "v", dim=dim)
    return out.drop("v"), centroids
