"""Exact duplicates by composable polynomial fingerprints (operator 3).

Texts are normalised (each run of ``[\\x20\\x09-\\x0D]`` becomes one space) and cut
into chunks of bytes. A chunk's hash is its polynomial modulo two primes; hashes
of neighbouring chunks combine by multiplying the left one with the base to the
length of the right one, so the chunks of a huge text are hashed side by side
and the result does not depend on how it was cut. Texts with equal fingerprints
and lengths are then compared chunk by chunk: for every (fingerprint, chunk) the
smallest and largest bytes must agree. These are partial aggregates, so a large
group of copies shrinks before it is shuffled. Should the bytes of a fingerprint
differ, its texts are grouped by their SHA-256 instead.

Null counts as empty text; empty texts are equal. Of equal texts the smallest id
stays (null ids last; of rows with the same id, any one). Every row is returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wreath.llm import textbytes as TB
from wreath.llm.common import join_groups, maybe_in, prepare, read, stored

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_291 % 2_147_483_629)
CHUNK = 1 << 16


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo prime, doubling the known part."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = pow(base, len(out), prime)
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
    return out[:n]


_TABLES: dict[int, list[np.ndarray]] = {}


def _tables(chunk: int) -> list[np.ndarray]:
    if chunk not in _TABLES:
        _TABLES[chunk] = [_power_table(b, p, chunk) for b, p in zip(BASES, PRIMES)]
    return _TABLES[chunk]


def combine(left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
    """Fingerprint of two neighbouring pieces from theirs."""
    return tuple((a * pow(b, right_length, p) + c) % p for a, c, b, p in zip(left, right, BASES, PRIMES))


def chunk_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int) -> list[np.ndarray]:
    """Polynomial of each [start, end) span of at most ``chunk`` bytes, modulo each
    prime; the spans follow each other without gaps."""
    out = []
    lengths = ends - starts
    back = np.repeat(ends - 1, lengths) - np.arange(starts[0], ends[-1]) if len(starts) else np.zeros(0, np.int64)
    filled = np.flatnonzero(lengths)
    for table, prime in zip(_tables(chunk), PRIMES):
        h = np.zeros(len(starts), np.uint64)
        if len(filled):
            terms = (data[starts[0]: ends[-1]].astype(np.uint64) + np.uint64(1)) * table[back]
            h[filled] = np.add.reduceat(terms, (starts - starts[0])[filled]) % np.uint64(prime)
        out.append(h)
    return out


def fingerprints(column, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, byte length) of each text; null counts as empty."""
    data, offsets = TB.utf8(column)
    fp, length = np.zeros(len(column), np.int64), np.diff(offsets)
    for i, j in TB.row_slices(offsets):
        n = -(-length[i:j] // chunk)
        row = np.repeat(np.arange(j - i), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        s = offsets[i:j][row] + nth * chunk
        e = np.minimum(s + chunk, offsets[i + 1: j + 1][row])
        parts = [np.concatenate(x) for x in zip(*(chunk_hashes(data, s[a:b], e[a:b], chunk)
                                                  for a, b in _span_groups(s, e)))] if len(s) else [s, s]
        first = np.flatnonzero(nth == 0)
        fp[i:j][n > 0] = (parts[0][first] << np.uint64(31) | parts[1][first]).astype(np.int64)
        for r in np.flatnonzero(n > 1):
            at = np.flatnonzero(row == r)
            acc = (0, 0)
            for q in at:
                acc = combine(acc, (int(parts[0][q]), int(parts[1][q])), int(e[q] - s[q]))
            fp[i + r] = acc[0] << 31 | acc[1]
    return fp, length


def _span_groups(s: np.ndarray, e: np.ndarray, limit: int = TB.SLICE_BYTES):
    """Runs of spans of about ``limit`` bytes, so that temporary arrays stay small."""
    a = 0
    while a < len(s):
        b = max(a + 1, int(np.searchsorted(e, s[a] + limit, side="right")))
        yield a, b
        a = b


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fingerprint_udf(chunk: int = CHUNK):
    @F.arrow_udf("struct<fp:long,bytes:long>")
    def fingerprint(texts: pa.Array) -> pa.Array:
        fp, n = fingerprints(texts, chunk)
        return pa.StructArray.from_arrays([pa.array(fp), pa.array(n)], ["fp", "bytes"])

    return fingerprint


def chunks_udf(chunk: int = CHUNK):
    @F.arrow_udf("array<binary>")
    def chunks(texts: pa.Array) -> pa.Array:
        return pa.array([[b[i: i + chunk] for i in range(0, len(b), chunk)] for b in
                         ((t.as_py() or "").encode() for t in texts)], pa.list_(pa.binary()))

    return chunks


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256,
    fingerprint, bytes."""
    text = normalised(F.col(text_col))
    base = stored(docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), fingerprint_udf(chunk)("t").alias("f"))
        .select(F.monotonically_increasing_id().alias("uid"), "id", "text_sha256", F.col("f.fp").alias("fingerprint"), "f.bytes"),
        "fingerprints")
    # texts that share a fingerprint; a few others pass the filter and compare with themselves
    shared = stored(base.groupBy("fingerprint", "bytes").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    same = docs.select(text.alias("t")).select("t", fingerprint_udf(chunk)("t").alias("f")).select(
        "t", F.col("f.fp").alias("fingerprint"), "f.bytes").where(maybe_in(shared, "fingerprint", "bytes"))
    # streaming comparison: every copy of a chunk must equal the smallest and the largest one
    differing = stored(same.select("fingerprint", "bytes", F.posexplode(chunks_udf(chunk)("t")).alias("nth", "part")).groupBy(
        "fingerprint", "bytes", "nth").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select(
        "fingerprint", "bytes").distinct().withColumn("clash", F.lit(True)), "clashes")
    keyed = base.join(differing, ["fingerprint", "bytes"], "left").withColumn(
        "split", F.when(F.col("clash"), F.col("text_sha256")).otherwise(""))
    keyed = stored(keyed.drop("clash"), "keyed")
    key = ["fingerprint", "bytes", "split"]
    keep = stored(keyed.groupBy(*key).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first"),
                                          F.count("*").alias("group_size")), "groups")
    return join_groups(keyed, keep, key, "group_size").select(
        "id", F.col("first.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"),
        "text_sha256", "fingerprint", "bytes")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: group of every document."""
    prepare(spark)
    g = exact_groups(read(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.t) AS text_sha256
FROM t JOIN g ON t.t = g.t
"""
