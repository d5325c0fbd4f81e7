"""Reproducible shuffle into shards by a Feistel permutation (operator 4).

Rows get global numbers 0..N-1 in the order of (id, text hash, size); a Feistel
network permutes the numbers, walking its cycles until the result is below N.
``shard = position mod shards`` and ``slot = position div shards``, so both are
computed from the row number alone, the counts of the shards differ by at most
one (law ``rows``) and slots have no gaps. :func:`row_at` inverts the walk: the
row of any shard and slot is found without reading the others.

The order does not depend on partitions: null ids come first, and rows equal in
id, text and size are interchangeable. Null text counts as empty (16 bytes of
size, CRC of no bytes); an empty table gives no rows. Other columns play no role.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wreath.llm import textbytes as TB
from wreath.llm.common import prepare, read, stored

SHARDS = 40
SEED = 20_24
ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    with np.errstate(over="ignore"):
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            salt = TB.mix(np.array([seed * 1_000 + r], np.uint64))[0]
            if back:
                left, right = right ^ (TB.mix(left ^ salt) & mask), left
            else:
                left, right = right, left ^ (TB.mix(right ^ salt) & mask)
    return left << shift | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Position of each row number in the shuffled order (``back``: the reverse)."""
    out = np.asarray(rows, np.uint64).copy()
    todo, bits = np.arange(len(out)), _half_bits(n)
    while len(todo):
        out[todo] = _network(out[todo], bits, seed, back)
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """Row number that lies in ``slot`` of ``shard``."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def numbered(keys: DataFrame, order: list[str], out_col: str = "row") -> DataFrame:
    """``keys`` with gapless numbers in the order of ``order``: ranges are sorted
    apart and shifted by the counts of the ranges before them, of which there
    are as many as partitions."""
    spread = stored(keys.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    counts = spread.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.col("__at").bitwiseAND((1 << 33) - 1)
    return (spread.withColumn("__part", part).join(before, "__part")
            .withColumn(out_col, F.col("__before") + inside).drop("__part", "__at", "__before"))


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                  seed: int = SEED) -> DataFrame:
    """One row per document: id, size, text_crc32, row, position, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = stored(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                              F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")), "keys")
    n = keys.count()

    @F.arrow_udf("long")
    def position(rows: pa.Array) -> pa.Array:
        return pa.array(permute(rows.to_numpy(zero_copy_only=False), n, seed))

    placed = numbered(keys, ["id", "text_hash", "size", "text_crc32"]).withColumn("position", position("row"))
    return placed.select("id", "size", "text_crc32", "row", "position", F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
                         F.floor(F.col("position") / shards).cast("long").alias("slot"))


def shard_digest(docs: DataFrame) -> DataFrame:
    return assign_shards(docs).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """Contract query: shard and slot of every document."""
    prepare(spark)
    return shard_digest(read(spark, sf_dir, "documents"))
