"""Session construction and the few session-level settings the library relies on."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import SparkSession

# Runtime SQL settings every job assumes. They are safe to apply to a session
# someone else built: none of them is a static (startup-only) setting.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "wreath") -> SparkSession:
    """A session for tests, the bench and local runs.

    On a cluster the session comes from the launcher; call :func:`configure`
    on it instead.
    """
    master = master or os.environ.get("WREATH_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WREATH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, so that a worker's memory follows the longest
    text rather than ten thousand of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory of this worker to the system. A worker is used again by later tasks and would
    otherwise keep what its largest batch needed, beside what the JVM needs by then."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``wreath`` importable in the Python workers (Arrow UDFs,
    ``applyInPandas`` and ``mapInPandas`` pickle library functions by
    reference). The package is zipped once per SparkContext and handed to
    ``addPyFile``, which distributes it to every executor."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import wreath

    root = os.path.dirname(os.path.dirname(os.path.abspath(wreath.__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="wreath-pkg-"), "wreath.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(os.path.join(root, "wreath")):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``,
    and a session without one is refused: a folder on the driver's own disk
    would lose data there. In local mode (tests, local runs), where driver and
    executors are one process, a fresh local folder takes its place.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
        conf_dir = tempfile.mkdtemp(prefix="wreath-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def cut_lineage(df):
    """Reliable checkpoint: survives executor loss, truncates the plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df):
    """Compute an intermediate that several branches read exactly once.

    Spark only reuses an exchange when both branches are identical after
    column pruning, which is rarely the case; without this the whole
    upstream plan is recomputed per branch. The result lands as Parquet below
    the session's checkpoint folder (shared storage on a cluster), so each
    branch reads only its columns and a lost executor costs a re-read, not a
    recomputation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
