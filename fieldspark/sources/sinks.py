"""Writers: per-region fields, batched variants, series and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.session import scratch_path


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], max_records: int = 0, replace: bool = True) -> None:
    """One folder per key, one job for all keys; for keys of few values.

    ``replace`` renews only the written keys of an existing table; a new table
    (``replace=False``) saves that second move of every file.  A rebalance hint
    sends small keys to one file each and lets AQE split a hot key.
    """
    w = df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").partitionBy(*by)
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    if replace:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def write_packed(df: DataFrame, path: str, by: Sequence[str], order: Sequence[str] = (), max_records: int = 5_000_000) -> None:
    """Many keys in few files: rows of a key together and sorted, so that row-group statistics prune a key's read.

    The number of files grows with the bytes and not with the keys; a hot key
    is split over several tasks by the rebalance.
    """
    out = df.hint("rebalance", *[F.col(c) for c in by]).sortWithinPartitions(*by, *order)
    out.write.mode("overwrite").option("maxRecordsPerFile", max_records).parquet(path)


def write_time_slabs(df: DataFrame, path: str, time: str, steps: int, max_records: int = 1_000_000) -> None:
    """Slabs of ``steps`` time steps, range-partitioned so that a slab's files hold adjacent times."""
    (df.withColumn("slab", F.floor(F.col(time) / steps)).repartitionByRange(F.col(time), F.col("iy"))
     .write.mode("overwrite").option("maxRecordsPerFile", max_records).partitionBy("slab").parquet(path))


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Flat CSV with a header; sorted output keeps one range of rows per part file."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").csv(path, header=True)


def write_and_read(spark: SparkSession, df: DataFrame, name: str, by: Sequence[str] = (), packed: bool = False) -> DataFrame:
    """Write to the shared folder and scan the result with the schema it was written with."""
    path = scratch_path(spark, name)
    if packed:
        write_packed(df, path, by)
    elif by:
        write_partitioned(df, path, by, replace=False)
    else:
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
