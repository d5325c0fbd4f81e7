"""Quoted CSV and TSV records that span lines, read in splits.

A file is read line by line, as splits of any text file are. Whether a line stands inside a
quoted field depends on the quotes before it, so:

1. the quotes of each split are counted; a running sum over the splits of a file tells which
   splits begin inside a field (only those are named to the tasks);
2. every split joins its lines to records from there on. What belongs to a record that began
   earlier, and a record that does not end in the split, leave as pieces;
3. the pieces, two a split at most, are put together in order.

So one large file is read by as many tasks as it has splits, and a field may be longer than a split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD, HEAD, TAIL = 0, 1, 2     # a whole record; the rest of an earlier one; one that goes on in the next split

_PIECES = "file string, block long, kind int, done boolean, value string"


def _records(quote: str, inside):
    """Lines of splits as records; the first record of a file is its header and left out."""
    names = ["file", "block", "kind", "done", "value"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, kind, open_, skip = None, [], RECORD, False, False
        out: list[tuple] = []

        def end_split() -> None:
            if held and not skip:
                out.append((*at, kind if kind == HEAD else TAIL, False, "\n".join(held)))

        for batch in batches:
            for file, block, line in zip(*(batch[c].to_pylist() for c in ("file", "block", "value"))):
                if (file, block) != at:
                    if at is not None:
                        end_split()
                    at, held = (file, block), []
                    open_ = (file, block) in inside.value
                    kind = HEAD if open_ else RECORD
                    skip = block == 0
                open_ ^= line.count(quote) % 2 == 1
                held.append(line)
                if not open_:
                    text = "\n".join(held)
                    if skip:
                        skip = False
                    elif kind == HEAD:
                        out.append((*at, HEAD, True, text))
                    elif text.strip("\r"):
                        out.append((*at, RECORD, True, text.removesuffix("\r")))
                    held, kind = [], RECORD
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)
                out = []
        if at is not None:
            end_split()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    return join


def read_records(spark: SparkSession, path, quote: str = '"') -> DataFrame:
    """(value): the records of delimited files below ``path`` (a path, a glob or a list), without their headers."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    odd = F.sum(F.length(F.regexp_replace("value", f"[^{quote}]", "")).cast("long")).alias("quotes")
    splits = lines.groupBy("file", "block").agg(odd)
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    opened = splits.withColumn("before", before).where("before % 2 = 1").select("file", "block").collect()   # at most one row a split
    inside = spark.sparkContext.broadcast(frozenset((r["file"], r["block"]) for r in opened))
    pieces = lines.mapInArrow(_records(quote, inside), _PIECES)
    whole = pieces.where(F.col("kind") == RECORD).select("value")
    if not opened:
        return whole
    parts = pieces.where(F.col("kind") != RECORD)
    number = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", "kind"))
    joined = parts.withColumn("record", number).groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "value"))), lambda p: p["value"]), "\n").alias("value"),
        F.bool_or(F.col("kind") == TAIL).alias("begun"))
    # a header that goes on in the next split has no beginning among the pieces
    return whole.unionByName(joined.where("begun").select(F.regexp_replace("value", "\r$", "").alias("value")))


def read_delimited(spark: SparkSession, path, schema: T.StructType | str, options: dict[str, str]) -> DataFrame:
    """Rows of delimited files with a header, by a declared schema and Spark's CSV options."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    records = read_records(spark, path, options.get("quote", '"'))
    return records.select(F.from_csv("value", ddl, {k: v for k, v in options.items() if k != "header"}).alias("r")).select("r.*")
