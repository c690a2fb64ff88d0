"""Sessions, written tables and schemas shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldspark.session import scratch_path

#: Arrow batches by bytes, so that long texts come few at a time and numbers many.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "2097152", "spark.sql.execution.arrow.maxRecordsPerBatch": "20000"}

#: Removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the written tables lie.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, under fixed names, so that further or clashing columns do not matter."""
    for key, value in BATCHES.items():
        df.sparkSession.conf.set(key, value)
    return df.select(*[df[c].alias(name) for name, c in columns.items()])


def tidy(run):
    """The batch function, giving freed memory back to the system at the end of its task: Python workers live on."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


def written(df: DataFrame, name: str, *more: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and safe from lost executors.

    Further frames are written into the same table, one after the other.  The shuffle files of each are removed
    when it is there, so that no two of them take disk at a time.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        for part in (df, *more):
            part.write.mode("append").options(**{"compression": "zstd", "parquet.writer.version": "v1"}).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more; no other frame is taken."""
    for table in tables:
        sc, path = table.sparkSession.sparkContext, _PATHS.pop(table)
        path = sc._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nobody holds any more; it finds them by collecting garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sql_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def ascii_lower(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
