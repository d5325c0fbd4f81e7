"""Readers, writers and JSON shaping for the workload's file formats.

Schemas are always declared (no inference): a wrong guess on 100 TB is a
full re-read, and a JSON number stored as a string would silently become
null under an integer schema. Numbers that may arrive quoted are read as
strings and cast.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wreath.session import ensure_checkpoint_dir
from wreath.sources.csv_splits import read_delimited

# One option set for reader and writer, so that a table comes back as it was:
# outer white space is kept, every string is quoted (so a newline at either end
# stays inside its field), and null is a mark of its own, apart from empty text.
# Files of others, with bare empty fields for null, are read with nullValue="".
NULL_MARK = "\\N"
CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "nullValue": NULL_MARK,
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_READ = {**CSV_OPTIONS, "multiLine": "true", "mode": "FAILFAST", "emptyValue": ""}     # multiLine: line ends in fields stay as they are
CSV_WRITE = {**CSV_OPTIONS, "quoteAll": "true", "emptyValue": ""}


# --------------------------------------------------------------------------- A1..A5
def read_table(spark: SparkSession, path, fmt: str, schema: T.StructType | str | None = None,
               **opts) -> DataFrame:
    """Read one path, a glob, or a list of paths (all files one batch).

    ``fmt``: parquet | json (one object per line) | csv | tsv. CSV/TSV have a
    header and quoted fields over several lines; large files are read in splits
    (:mod:`wreath.sources.csv_splits`).
    """
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    elif fmt in ("json", "csv", "tsv"):
        raise ValueError("json/csv/tsv need an explicit schema")
    if fmt in ("csv", "tsv"):
        o = dict(CSV_READ)
        if fmt == "tsv":
            o["sep"] = "\t"
        o.update(opts)
        return read_delimited(spark, path, schema, o)
    if fmt == "json":
        return r.options(**opts).json(path)
    if fmt == "parquet":
        return r.options(**opts).parquet(*(path if isinstance(path, (list, tuple)) else [path]))
    raise ValueError(fmt)


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast string-held numbers (e.g. year/month written as JSON strings);
    ``try_cast`` keeps a bad value as null instead of failing the job."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


# --------------------------------------------------------------------------- A6..A10
def write_table(df: DataFrame, path: str, fmt: str, partition_by: Sequence[str] = (),
                codec: str | None = None, level: int | None = None, mode: str = "overwrite") -> None:
    """Write a whole result in one job (no per-group append loop, quirk Q1).

    CSV/TSV carry a header per part file. ``codec``/``level`` set parquet
    compression, e.g. zstd level 12 or 15.
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        if codec:
            w = w.option("compression", codec)
        if level is not None:
            w = w.option(f"parquet.compression.codec.{codec or 'zstd'}.level", str(level))
        w.parquet(path)
    elif fmt in ("csv", "tsv"):
        w = w.options(**CSV_WRITE)
        if fmt == "tsv":
            w = w.option("sep", "\t")
        w.csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(fmt)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's reliable checkpoint folder (the
    cluster's shared storage), never a machine-local temporary folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- A11
DOCS_SCHEMA = T.StructType([T.StructField("response", T.StructType([
    T.StructField("docs", T.ArrayType(T.StructType([
        T.StructField("_id", T.StringType()),
        T.StructField("print_page", T.StringType()),
        T.StructField("headline", T.StructType([T.StructField("print_headline", T.StringType())])),
        T.StructField("abstract", T.StringType()),
    ])))]))])


def flatten_docs(df: DataFrame, json_col: str, keep: Column | None = None,
                 stamp: Sequence[str] = ("year", "month")) -> DataFrame:
    """One row per article of an archive response: ``response.docs``
    exploded, nested fields picked, only print page "1" kept (``keep``
    overrides), and the request's year and month stamped on (read as strings,
    cast to int). A missing level gives null, never an error."""
    parsed = df.select(*stamp, F.from_json(F.col(json_col), DOCS_SCHEMA).alias("__j"))
    docs = parsed.select(*stamp, F.explode(F.col("__j.response.docs")).alias("d"))
    cond = keep if keep is not None else (F.col("d.print_page") == "1")
    out = docs.filter(cond).select(
        F.col("d._id").alias("id"),
        F.col("d.headline.print_headline").alias("headline"),
        F.col("d.abstract").alias("abstract"),
        *stamp)
    return cast_columns(out, {s: "int" for s in stamp})


# --------------------------------------------------------------------------- A12
def flatten_bindings(df: DataFrame, json_col: str, keys: Sequence[str],
                     keep: Sequence[str] = ()) -> DataFrame:
    """``{k: {value: v}}`` -> one column per key, null where a key is absent."""
    m = F.from_json(F.col(json_col), T.MapType(T.StringType(),
                                               T.StructType([T.StructField("value", T.StringType())])))
    return df.select(*keep, m.alias("__m")).select(
        *keep, *[F.try_element_at(F.col("__m"), F.lit(k))["value"].alias(k) for k in keys])


# --------------------------------------------------------------------------- A15
def request_key(*cols) -> Column:
    """SHA-256 hex of the request text (one column) or of its parts joined
    by U+0001."""
    c = cols[0] if len(cols) == 1 else F.concat_ws("\u0001", *cols)
    c = F.col(c) if isinstance(c, str) else c
    return F.sha2(c, 256)


def pending_requests(requests: DataFrame, cache: DataFrame, key_col: str = "key") -> DataFrame:
    """Requests whose key is not in the cache yet (left anti join): only these
    need fetching. The cache may be as large as the request set, so no
    broadcast is forced; AQE picks one when the cache is small."""
    return requests.join(cache.select(key_col).distinct(), key_col, "left_anti")
