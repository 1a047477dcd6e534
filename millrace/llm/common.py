"""What the operators of this package share: the shared folder, written tables, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import ship  # noqa: F401  (operators take it from here)

#: The setting by which a command's shuffle files go when it ends, not when the driver happens to collect garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is unset (local tests) a temporary folder is made once and kept in the session.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors.

    The shuffle files of the write are removed once the table stands, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``materialize`` has returned, once nothing that is still to be computed reads them."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._millrace_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(batches, rows: int = 256):
    """Arrow batches cut to a few rows, so that Python objects of few documents exist at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_cache_in_use: list = []


def use_cache(name: str, clear) -> None:
    """Called where a task begins to use a worker's cache: a cache of another name, left by an earlier stage, is cleared."""
    if _cache_in_use and _cache_in_use[0] != name:
        _cache_in_use[1]()
    _cache_in_use[:] = [name, clear]


def release() -> None:
    """Gives memory that a Python worker has freed back to the system; idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def hold_batches(spark: SparkSession) -> None:
    """Texts can be long, so Arrow batches of this session are held to 1000 rows from here on.

    The setting is read when a query runs, so it cannot be put back before; it changes no result.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents."""
    hold_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
