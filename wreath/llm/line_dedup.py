"""Line dedup with compressed per-document keep bitmaps (operator 11).

Texts are cut at ``\\n``. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its
ends and with A-Z lower-cased. The 128-bit hashes of all keys are range-partitioned
by (hash, document id, row, position), so a line that makes up a third of all lines
spreads over many ranges, and every range is sorted in that order. A range is then
streamed once: a key's documents are counted as they come, and its lines leave the
stream as soon as ``min_docs`` documents are reached. Only the first and the last
key of a range can go on in a neighbour; their lines leave undecided, and one
summary for each such key and range is settled on the driver.

What leaves is (row, position) of dropped lines, gathered into one bitmap for each
document (bits of kept lines, most significant first, deflated). No text is
shuffled for it. With ``keep_first`` the first line of a key, in the order of
document id (nulls last), row and position, stays.

Null and empty texts have one empty line, which is kept, as all lines whose key has
fewer than ``min_chars`` code points. Every row is a document of its own, also
with a repeated or null id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wreath.llm import textbytes as TB
from wreath.llm.common import maybe_in, prepare, read, stored

WHITE = b" \t\n\x0b\x0c\r"
MIN_DOCS = 10
MIN_CHARS = 1
BLOCK = 1 << 20           # bytes of a text that are cut into lines at a time
BATCH_ROWS = 1 << 16
#: rows of the stream: a dropped line, an undecided one of a range's first or last key, a summary of these keys
DROPPED, OF_FIRST, OF_LAST, FIRST_KEY, LAST_KEY = range(5)


def line_blocks(raw: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The lines of a text in runs of about ``block`` bytes."""
    start = 0
    while True:
        end = raw.find(b"\n", start + block)
        if end < 0:
            yield raw[start:].split(b"\n")
            return
        yield raw[start:end].split(b"\n")
        start = end + 1


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()       # bytes.lower() changes A-Z alone


def encode_bitmap(dropped, n_lines: int) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[np.asarray(dropped, np.int64)] = False
    return zlib.compress(np.packbits(keep).tobytes())


def decode_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)


def kept_lines(raw: bytes, bitmap: bytes | None, n_lines: int) -> Iterator[bytes]:
    """The kept lines of a text, joined by ``\\n``, in pieces."""
    keep = None if bitmap is None else decode_bitmap(bitmap, n_lines)
    at, begun = 0, False
    for lines in line_blocks(raw):
        left = lines if keep is None else [x for x, k in zip(lines, keep[at: at + len(lines)]) if k]
        at += len(lines)
        if left:
            yield (b"\n" if begun else b"") + b"\n".join(left)
            begun = True


def _occurrences(min_chars: int, id_type: pa.DataType):
    names = ["h1", "h2", "id", "uid", "pos"]

    def batch_of(digests: list, rows: list, at: list, ids, uids) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        rows = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), ids.take(rows).cast(id_type),
                                           uids.take(rows), pa.array(np.concatenate(at))], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = TB.utf8(batch["text"])
            digests, rows, at = [], [], []
            for r in range(batch.num_rows):
                first = 0
                for lines in line_blocks(data[offsets[r]: offsets[r + 1]].tobytes()):
                    keys = [line_key(x) for x in lines]
                    here = [i for i, k in enumerate(keys) if k and (min_chars <= 1 or len(k.decode("utf-8", "replace")) >= min_chars)]
                    digests += [xxhash.xxh3_128_digest(keys[i]) for i in here]
                    at.append(np.array(here, np.int64) + first)
                    rows.append(np.full(len(here), r, np.int64))
                    first += len(lines)
                    if len(digests) >= BATCH_ROWS:
                        yield batch_of(digests, rows, at, batch["id"], batch["uid"])
                        digests, rows, at = [], [], []
            if digests:
                yield batch_of(digests, rows, at, batch["id"], batch["uid"])

    return cut


_MARKS = "part long, kind int, uid long, pos long, first boolean, h1 long, h2 long, docs long"


def _marked(min_docs: int, keep_first: bool):
    """Stream of a sorted range: see the module's text."""
    schema = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("uid", pa.int64()), ("pos", pa.int64()),
                        ("first", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64()), ("docs", pa.int64())])

    def lines(part: int, kind: int, uid, pos, first) -> pa.RecordBatch:
        n = len(uid)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int64)), pa.array(np.full(n, kind, np.int32)), pa.array(uid),
                                           pa.array(pos), pa.array(first), none, none, none], schema=schema)

    def summary(part: int, kind: int, run: dict) -> pa.RecordBatch:
        values = (part, kind, run["from"], run["to"], None, *run["key"], run["docs"])
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, run, leading = TaskContext.get().partitionId(), None, None

        def grow(uid, pos, docs: int, opens: bool) -> Iterator[pa.RecordBatch]:
            """Rows of the open key: passed on, or held until it is known what becomes of them."""
            first = np.zeros(len(uid), bool)
            first[0] = opens
            run["docs"] += docs
            run["to"] = int(uid[-1])
            if run["leads"]:
                yield lines(part, OF_FIRST, uid, pos, first)
                return
            run["held"].append((uid, pos, first))
            if run["docs"] >= min_docs:
                for u, p, f in run["held"]:
                    yield from drop(u, p, f)
                run["held"] = []

        def drop(uid, pos, first) -> Iterator[pa.RecordBatch]:
            go = ~first if keep_first else np.ones(len(uid), bool)
            if go.any():
                yield lines(part, DROPPED, uid[go], pos[go], first[go])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, uid, pos = (batch[c].to_numpy(zero_copy_only=False) for c in ("h1", "h2", "uid", "pos"))
            goes_on = run is not None and run["key"] == (int(h1[0]), int(h2[0]))
            new_key = np.r_[not goes_on, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_key | np.r_[not goes_on or run["to"] != int(uid[0]), uid[1:] != uid[:-1]]
            starts = np.flatnonzero(new_key)
            if goes_on:
                end = int(starts[0]) if len(starts) else n
                yield from grow(uid[:end], pos[:end], int(new_doc[:end].sum()), False)
            if not len(starts):
                continue
            ends = np.r_[starts[1:], n]
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            # keys that begin and end inside the batch; the range's first key is not among them
            inner = np.arange(1 if run is None else 0, len(starts) - 1)
            often = inner[docs[inner] >= min_docs]
            if len(often):
                take = np.zeros(n + 1, np.int64)
                np.add.at(take, starts[often], 1)
                np.add.at(take, ends[often], -1)
                at = np.cumsum(take)[:n] > 0
                yield from drop(uid[at], pos[at], new_key[at])
            for k in ([0] if run is None and len(starts) > 1 else []) + [len(starts) - 1]:
                a, b = int(starts[k]), int(ends[k])
                leads = leading is None
                run = {"key": (int(h1[a]), int(h2[a])), "docs": 0, "from": int(uid[a]), "to": -1, "leads": leads, "held": []}
                leading = run if leads else leading
                yield from grow(uid[a:b], pos[a:b], int(docs[k]), True)
        if run is not None:
            for u, p, f in run["held"]:
                yield lines(part, OF_LAST, u, p, f)
            yield summary(part, FIRST_KEY, leading)
            if run is not leading:
                yield summary(part, LAST_KEY, run)

    return stream


def _settled(ends, min_docs: int) -> list[tuple[int, int, bool, bool]]:
    """(range, kind of its undecided lines, frequent, begun in an earlier range)."""
    chains: list[list] = []
    for r in ends:
        key = (r["h1"], r["h2"])
        if chains and r["kind"] == FIRST_KEY and chains[-1][0] == key:
            chain = chains[-1]
            chain[1] += r["docs"] - (chain[2] == r["uid"])
            chain[2] = r["pos"]
        else:
            chains.append(chain := [key, r["docs"], r["pos"], []])
        chain[3].append((r["part"], OF_FIRST if r["kind"] == FIRST_KEY else OF_LAST))
    return [(part, kind, docs >= min_docs, i > 0) for _, docs, _, runs in chains for i, (part, kind) in enumerate(runs)]


def numbered_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored (uid, id, text, n_lines); null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return stored(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), text.alias("text"),
                              (F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("n_lines")), "lines", compression="zstd")


def dropped_lines(texts: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(uid, pos) of the lines to drop from :func:`numbered_texts`."""
    spark = texts.sparkSession
    id_type = texts.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("id", id_type),
                           T.StructField("uid", T.LongType()), T.StructField("pos", T.LongType())])
    found = texts.select("id", "uid", "text").mapInArrow(_occurrences(min_chars, to_arrow_type(id_type)), schema)
    order = ["h1", "h2", F.col("id").asc_nulls_last(), "uid", "pos"]
    spread = found.repartitionByRange(*order).sortWithinPartitions(*order).select("h1", "h2", "uid", "pos")
    marks = stored(spread.mapInArrow(_marked(min_docs, keep_first), _MARKS), "marks")
    ends = marks.where(F.col("kind").isin(FIRST_KEY, LAST_KEY)).orderBy("part", "kind").collect()   # two a range at most
    settled = spark.createDataFrame(_settled(ends, min_docs), "part long, kind int, often boolean, continued boolean")
    edge = marks.where(F.col("kind").isin(OF_FIRST, OF_LAST)).join(F.broadcast(settled), ["part", "kind"]).where("often")
    if keep_first:
        edge = edge.where("continued or not first")
    return marks.where(F.col("kind") == DROPPED).select("uid", "pos").unionByName(edge.select("uid", "pos"))


def _bitmap(positions: pa.Array, n_lines: pa.Array) -> pa.Array:
    flat, off = positions.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(positions.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    made = [encode_bitmap(flat[a:b], n) for a, b, n in zip(off[:-1], off[1:], n_lines.to_pylist())]
    return pa.StructArray.from_arrays([pa.array(np.diff(off).astype(np.int64)), pa.array(made, pa.binary())], ["n_dropped", "keep"])


def keep_bitmaps(texts: DataFrame, dropped: DataFrame) -> DataFrame:
    """(uid, id, n_lines, n_dropped, keep), one row per document."""
    by_doc = dropped.groupBy("uid").agg(F.collect_list("pos").alias("positions"))
    return texts.select("uid", "id", "n_lines").join(by_doc, "uid", "left").withColumn("b", F.arrow_udf(_bitmap, "struct<n_dropped:long,keep:binary>")("positions", "n_lines")).select(
        "uid", "id", "n_lines", "b.n_dropped", "b.keep")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(id, n_lines, n_dropped, keep): the keep bitmap of every document."""
    texts = numbered_texts(docs, id_col, text_col)
    return keep_bitmaps(texts, dropped_lines(texts, min_docs, min_chars, keep_first)).drop("uid")


def _kept_sha256(texts: pa.Array, keep: pa.Array, n_lines: pa.Array) -> pa.Array:
    data, offsets = TB.utf8(texts)
    out = []
    for r, (bitmap, n) in enumerate(zip(keep, n_lines.to_pylist())):
        sha = hashlib.sha256()
        for piece in kept_lines(data[offsets[r]: offsets[r + 1]].tobytes(), bitmap.as_py(), n):
            sha.update(piece)
        out.append(sha.hexdigest())
    return pa.array(out, pa.string())


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: lines of every document before and after."""
    prepare(spark)
    texts = numbered_texts(read(spark, sf_dir, "documents"))
    bitmaps = stored(keep_bitmaps(texts, dropped_lines(texts)).where("n_dropped > 0").select("uid", "n_dropped", "keep"), "bitmaps")
    # texts without a dropped line stay where they are; a few more of them than need be are joined.
    # The bitmaps grow with the texts, so they are never broadcast: one plan at every size
    changed = maybe_in(bitmaps, "uid")
    some = texts.where(changed).join(bitmaps.hint("merge"), "uid", "left").select(
        F.col("id").alias("doc_id"), "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.arrow_udf(_kept_sha256, "string")("text", "keep", "n_lines").alias("kept_sha256"))
    return texts.where(~changed).select(F.col("id").alias("doc_id"), "n_lines", F.lit(0).cast("long").alias("n_dropped"),
                                        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")).unionByName(some)


OP11_SQL = r"""
WITH l AS (SELECT rowid_, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
           FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rowid_) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rowid_, doc_id
"""
