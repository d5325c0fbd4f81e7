"""Cumulative-snapshot collapse of logged conversations, and rendering (operator 2).

A chat client often logs a conversation again after every turn, so the log holds
all its prefixes. Each conversation gets rolling hashes of its turn prefixes; one
that equals a prefix of a longer one (or the whole of an equally long one with a
smaller id) is a snapshot, and only maximal conversations are rendered.

Rolling hashes are polynomials over turn hashes modulo two primes. Rows are sorted
by (conversation, turn, role, text) in ranges, also between ranges (cut at the first
characters of a text, so that what is sampled for the cuts stays bounded; tied texts
that agree in them stand in one range). Every range hashes its own rows, and
the last run of a range is carried into the next by length-shifted arithmetic, so
one conversation may spread over many tasks. What comes to the driver is one
summary per range.

Turns are ordered by number (null first), then role, then text; a row repeated in
all four counts once. Null and empty text or role differ. Rows without a
conversation id form one conversation. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wreath.llm.common import prepare, read, stored
from wreath.llm.poly_fingerprint import BASES, PRIMES, _power_table


SAMPLE_CHARS = 64_000_000    # characters of text sampled for the cuts between ranges
LEAST_HEAD = 128


def _flags(*cols) -> list:
    return [x for c in cols for x in (F.col(c).isNull(), F.col(c))]


def _prefix_hashes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(position in its run, hash of the run up to each row) for runs that start
    at ``first``; sums of hash * base**position."""
    head = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    at = np.arange(len(hashes)) - head[run]
    out = []
    for base, prime in zip(BASES, PRIMES):
        p = np.uint64(prime)
        terms = hashes % p * _power_table(base, prime, int(at.max()) + 1)[at] % p
        sums = np.cumsum(terms)
        before = sums[head] - terms[head]
        out.append((sums - before[run]) % p)
    return at, out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local positions and prefix hashes of a sorted range."""
    from pyspark import TaskContext

    part, open_key, offset, carry, run_no = TaskContext.get().partitionId(), None, 0, (0, 0), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.array(batch["key"].to_pylist(), object)
        first = np.r_[True, key[1:] != key[:-1]]
        at, parts = _prefix_hashes(batch["h"].to_numpy(zero_copy_only=False).view(np.uint64), first)
        run = np.cumsum(first) - 1
        if open_key is not None and key[0] == open_key:
            same = run == 0
            at = at + np.where(same, offset, 0)
            for i, (base, prime) in enumerate(zip(BASES, PRIMES)):
                moved = (parts[i][same] * np.uint64(pow(base, offset, prime)) + np.uint64(carry[i])) % np.uint64(prime)
                parts[i][same] = moved
        elif open_key is not None:
            run_no += 1
        runs = run + run_no
        open_key, offset, run_no = key[-1], int(at[-1]) + 1, int(runs[-1])
        carry = tuple(int(p[-1]) for p in parts)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(np.full(len(key), part, np.int64)), pa.array(runs == 0), pa.array(at),
             *(pa.array(p.astype(np.int64)) for p in parts)],
            [*batch.schema.names[:-1], "part", "opens", "at", "p1", "p2"])


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv, key, turn, role, text, n, p1, p2): each distinct turn with its
    number from 1 and the hash of its conversation up to it."""
    rows = (turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
            .withColumn("h", F.xxhash64(*_flags("role", "text")))
            .withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))))
    rows = stored(rows.groupBy("key", "turn", "h").agg(F.first("conv").alias("conv"), F.first("role").alias("role"), F.first("text").alias("text")), "turns")
    # Spark samples up to 300 rows a range to cut the ranges; the order is that of the sort below
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head = F.substring("text", 1, max(LEAST_HEAD, SAMPLE_CHARS // (300 * parts)))
    spread = rows.select("conv", "key", "turn", "role", "text", "h").repartitionByRange("key", "turn", "role", head).sortWithinPartitions("key", "turn", "role", "text")
    schema = T.StructType([f for f in spread.schema.fields if f.name != "h"] + [
        T.StructField("part", T.LongType()), T.StructField("opens", T.BooleanType()),
        *[T.StructField(c, T.LongType()) for c in ("at", "p1", "p2")]])
    local = stored(spread.mapInArrow(_scan, schema), "scanned")
    # per range: its first and last conversation, and what the last one has reached
    ends = local.groupBy("part").agg(
        F.max_by("key", F.when(F.col("opens"), F.col("at"))).alias("first"),
        F.max_by(F.struct("key", "at", "p1", "p2"), F.struct("key", "at")).alias("last")).orderBy("part").collect()
    carried, key, reached = [], None, (0, 0, 0)
    for r in ends:
        start = reached if key == r["first"] else (0, 0, 0)
        carried.append((r["part"], *start))
        last = r["last"]
        if last["key"] != r["first"]:
            start = (0, 0, 0)
        n = last["at"] + 1
        reached = (start[0] + n, *((s + pow(b, start[0], p) * h) % p for s, b, p, h in zip(start[1:], BASES, PRIMES, (last["p1"], last["p2"]))))
        key = last["key"]
    spark = turns.sparkSession
    # the shifting powers are computed here, one row a range
    moves = spark.createDataFrame([(p, n, a, b, *(pow(base, n, prime) for base, prime in zip(BASES, PRIMES))) for p, n, a, b in carried],
                                  "part long, c0 long, c1 long, c2 long, b1 long, b2 long")
    joined = local.join(moves, "part")
    shift = lambda h, c, b, p: F.when(F.col("opens"), (F.col(c) + F.col(b) * F.col(h)) % F.lit(p)).otherwise(F.col(h))
    return joined.select("conv", "key", "turn", "role", "text",
                         (F.when(F.col("opens"), F.col("c0")).otherwise(0) + F.col("at") + 1).alias("n"),
                         shift("p1", "c1", "b1", PRIMES[0]).alias("p1"), shift("p2", "c2", "b2", PRIMES[1]).alias("p2"))


def collapse(turns: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """(numbered turns, one row per conversation: key, conv, n_turns, keep_key,
    keep_id, kept)."""
    rows = stored(numbered_turns(turns, **columns), "prefixes")
    whole = rows.groupBy("key").agg(F.max(F.struct("n", "p1", "p2", "conv")).alias("w")).select(
        "key", F.col("w.conv").alias("conv"), F.col("w.n").alias("n_turns"), F.col("w.p1").alias("p1"), F.col("w.p2").alias("p2"))
    longest = rows.select("key", "n", "p1", "p2").join(whole.select("key", "conv", "n_turns"), "key").groupBy("n", "p1", "p2").agg(
        F.min(F.struct((-F.col("n_turns")).alias("shorter"), F.col("conv").isNull().alias("none"), "conv", "key")).alias("best"))
    found = whole.join(longest.withColumnRenamed("n", "n_turns"), ["n_turns", "p1", "p2"]).select(
        "key", "conv", "n_turns", F.col("best.key").alias("keep_key"), F.col("best.conv").alias("keep_id"),
        (F.col("best.key") == F.col("key")).alias("kept"))
    return rows, found


def render(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Turns of maximal conversations as text segments: joined in the order of
    ``position`` they are the rendered conversation."""
    kept = found.where("kept").select("key", "n_turns")
    segment = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    return rows.join(kept, "key").select("conv", (F.col("n") - 1).alias("position"), "n_turns", segment.alias("segment"))


def op2_chat_snapshots(spark, sf_dir: str) -> DataFrame:
    """Rendered turns of maximal conversations, and one row (position null) for
    each snapshot with the conversation that covers it."""
    prepare(spark)
    rows, found = collapse(read(spark, sf_dir, "conversations"))
    shown = render(rows, found).select(F.col("conv").alias("conv_id"), F.col("conv").alias("keep_id"), "n_turns", "position", "segment")
    hidden = found.where("not kept").select(F.col("conv").alias("conv_id"), "keep_id", "n_turns", F.lit(None).cast("long").alias("position"),
                                            F.lit(None).cast("string").alias("segment"))
    return shown.unionByName(hidden)


OP2_SQL = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l,
             count(*) AS n_turns FROM d GROUP BY conv_id),
p AS (SELECT conv_id, n_turns, unnest(range(1, n_turns + 1)) AS n, l FROM c),
q AS (SELECT list_slice(l, 1, n) AS l, first(conv_id ORDER BY n_turns DESC, conv_id) AS keep_id FROM p GROUP BY list_slice(l, 1, n)),
f AS (SELECT c.conv_id, q.keep_id, c.n_turns, c.l FROM c JOIN q ON c.l = q.l),
s AS (SELECT conv_id, n_turns, l, unnest(range(0, n_turns)) AS position FROM f WHERE conv_id = keep_id)
SELECT conv_id, conv_id AS keep_id, n_turns, position,
       '<|' || coalesce(l[position + 1].r, '') || '|>' || chr(10) || coalesce(l[position + 1].t, '') || chr(10) || '<|end|>' || chr(10) AS segment
FROM s
UNION ALL
SELECT conv_id, keep_id, n_turns, NULL, NULL FROM f WHERE conv_id <> keep_id
"""
