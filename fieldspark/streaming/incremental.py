"""Incremental batches: only files or partitions that were not processed yet."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def missing_partitions(wanted: DataFrame, built: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Partitions to run: those not built and valid yet, or all with ``force``."""
    if force:
        return wanted
    return wanted.join(built.where("valid").select(*keys).distinct(), list(keys), "left_anti")


def _snapshot(spark: SparkSession, sink: str) -> int:
    """Number of the last finished snapshot, 0 before the first."""
    marks = _read(spark, f"{sink}/marks")
    return (marks.agg(F.max("snapshot")).first()[0] or 0) if marks is not None else 0


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:  # nothing was written there yet
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _merged(spark: SparkSession, sink: str, snapshot: int, keys: Sequence[str]) -> DataFrame | None:
    """Window states of a snapshot and of the batches after it, summed."""
    states = [d for d in (_read(spark, f"{sink}/base/snapshot={snapshot}"), _read(spark, f"{sink}/parts/after={snapshot}")) if d is not None]
    if not states:
        return None
    names = [c for c in states[0].columns if c not in ("start", *keys, "batch")]
    rows = states[0].select("start", *keys, *names)
    for d in states[1:]:
        rows = rows.unionByName(d.select("start", *keys, *names))
    return rows.groupBy("start", *keys).agg(*[F.sum(c).alias(c) for c in names])


def rollup_new_files(
    spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, time: str, value: str, keys: Sequence[str],
    window: str = "7 days", compact_after: int = 16,
) -> None:
    """Sum ``value`` per tumbling window over the files that arrived since the last run, then stop.

    Progress lives in ``checkpoint``; a restart neither repeats nor skips files.  A batch writes the partial
    sums of its own rows, however late, into a folder of its own, which a repeated batch replaces; nothing is
    kept in a state store.  :func:`read_rollup` merges them.  When a run ends with ``compact_after`` batches
    or more, they are merged into a snapshot, and later batches go behind it: readers list the last snapshot
    and what follows, never older folders (which the store may expire).  A snapshot counts from the moment
    that its mark, one small file, is written.
    """
    snapshot = _snapshot(spark, sink)
    parts = f"{sink}/parts/after={snapshot}"

    def save(rows: DataFrame, batch: int) -> None:
        sums = rows.withColumn(time, F.col(time).cast("timestamp")).groupBy(F.window(time, window).alias("w"), *keys).agg(
            F.count(F.lit(1)).alias("n"), F.sum(value).alias(value))
        sums.select(F.col("w.start").alias("start"), *keys, "n", value).write.mode("overwrite").parquet(f"{parts}/batch={batch}")

    q = (spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(save)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    batches = _read(spark, parts)
    if batches is not None and batches.select("batch").distinct().count() >= compact_after:
        compact(spark, sink, keys)


def compact(spark: SparkSession, sink: str, keys: Sequence[str]) -> None:
    """Merge a roll-up's batches into a new snapshot; between runs only, when every batch is committed."""
    snapshot = _snapshot(spark, sink)
    rows = _merged(spark, sink, snapshot, keys)
    if rows is None:
        return
    rows.write.mode("overwrite").parquet(f"{sink}/base/snapshot={snapshot + 1}")
    spark.createDataFrame([(snapshot + 1,)], "snapshot int").coalesce(1).write.mode("append").parquet(f"{sink}/marks")


def read_rollup(spark: SparkSession, sink: str, keys: Sequence[str]) -> DataFrame:
    """The windows of a roll-up: start, keys, n and the summed value."""
    rows = _merged(spark, sink, _snapshot(spark, sink), keys)
    if rows is None:
        raise ValueError(f"no roll-up at {sink}")
    return rows


def process_new_files(spark: SparkSession, source: str, schema: StructType, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Hand the rows of new files to ``batch`` (idempotent per batch id), then stop."""
    q = (spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
