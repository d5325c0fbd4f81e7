"""Session, storage and sampling helpers shared by the operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wreath.llm.textbytes import give_back
from wreath.session import bound_batches, ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder and package for the workers, and bounded Arrow batches. Other settings stay as they are."""
    ensure_checkpoint_dir(spark)
    bound_batches(spark)
    ship_package(spark)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/wreath-llm-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: several branches read
    it without computing it again, row ids in it stay fixed, and a lost executor
    costs a re-read. ``options`` are those of the Parquet writer."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    give_back()
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def unit_hash(*cols) -> Column:
    """Reproducible number in [0, 1) from the values of ``cols``."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") / F.lit(float(1 << 53))


def bounded_share(n_rows: int, n_bytes: int, max_rows: int, max_bytes: int) -> float:
    """Share of rows to draw so that a sample keeps to both bounds on average."""
    return min(1.0, max_rows / max(1, n_rows), max_bytes / max(1, n_bytes))


HOT_SHARE = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with one row per group, whose ``size`` counts its rows.

    Groups with a thousandth of all rows or more, of which there can be at most
    HOT_SHARE, are broadcast and their rows stay where they are; only the rows
    of smaller groups are shuffled. Both inputs should be stored tables."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * HOT_SHARE >= total)
    rest = groups.where(F.col(size) * HOT_SHARE < total)
    large = rows.join(F.broadcast(hot), key)
    small = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key)
    return large.unionByName(small)


FILTER_BITS_MAX = 1 << 27    # 16 MB


def maybe_in(wanted: DataFrame, *cols: str) -> Column:
    """Condition that holds for every row whose ``cols`` are in ``wanted`` and
    for few others: a bit field over hashes, sixteen bits a key up to
    FILTER_BITS_MAX, is broadcast. Beyond that size it only lets more through."""
    n = wanted.count()
    bits = 1 << min(max(16, (16 * n).bit_length()), FILTER_BITS_MAX.bit_length() - 1)
    at = F.xxhash64(*cols).bitwiseAND(bits - 1)
    words = wanted.select(at.alias("bit")).groupBy(F.shiftright("bit", 5).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits")).toArrow()
    field = np.zeros(bits // 32, np.uint32)
    field[words["at"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    shared = wanted.sparkSession.sparkContext.broadcast(field.view(np.uint8))

    @F.arrow_udf("boolean")
    def may_be(bit: pa.Array) -> pa.Array:
        b = bit.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0)

    return may_be(at)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int,
                    seed: int) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """(id, y, text) of about ``max_rows`` labelled documents per label 0 and 1,
    the numbers of labels, and the shares drawn.

    An id with both labels counts as 0. The draw is made on the labels, by a hash of the id, so what is broadcast to
    the scan of the documents is bounded by the sample and no text is shuffled."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null").groupBy("__id").agg(
        F.min("__y").alias("__y"))
    count = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    share = {y: bounded_share(n, 0, max_rows, 1) for y, n in count.items()}
    drawn = known.where(unit_hash("__id", F.lit(seed)) < F.when(F.col("__y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(drawn), "__id")
    return sample, count, share
