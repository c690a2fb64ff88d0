"""Reductions of cubes over regions, and per-region extraction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.regrid import every_slice
from fieldspark.session import shared_dir


def zonal_sum(
    cells: DataFrame,
    region_cells: DataFrame,
    sums: Mapping[str, Column],
    int_sums: Mapping[str, Column] | None = None,
    time: str = "t",
    regions: DataFrame | None = None,
) -> DataFrame:
    """Sum variables over every (region, time) in one pass.

    Missing values are skipped and an all-missing sum is 0.  The aggregation is
    partial before the shuffle, so a hot region costs one row per task; how the
    mask is joined is left to Spark, which knows its size when it runs.  With
    ``regions`` every (region, step) is reported, even without cells: cells
    outside all regions are then reduced as well, for the steps, and the reduced
    table is checkpointed, so that the cube is read once.
    """
    ints = dict(int_sums or {})
    total = {n: F.sum(F.nanvl(c.cast("double"), F.lit(None))) for n, c in {**sums, **ints}.items()}
    out = cells.join(region_cells, ["iy", "ix"], "inner" if regions is None else "left").groupBy("region", time).agg(
        *[c.alias(n) for n, c in total.items()])
    if regions is not None:
        shared_dir(cells.sparkSession)
        out = out.checkpoint()
        frame = every_slice(regions.select("region").distinct(), out, [time])
        out = frame.join(out.where("region is not null"), ["region", time], "left")
    fixed = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in sums}
    fixed |= {n: F.coalesce(F.round(F.col(n)), F.lit(0)).cast("bigint") for n in ints}
    return out.withColumns(fixed)


def with_grand_total(table: DataFrame, values: Sequence[str], time: str = "t", name: str = "total") -> DataFrame:
    """Append the sum over regions as one more region, from the reduced table.

    Cells shared by regions count once per region.  Nothing is added when the
    name is taken.
    """
    taken = table.where(F.col("region") == name).select(F.lit(1).alias("one")).limit(1)
    total = table.groupBy(time).agg(*[F.sum(v).alias(v) for v in values]).withColumn("region", F.lit(name))
    total = total.where(F.coalesce(taken.scalar(), F.lit(0)) == 0)
    return table.unionByName(total.select(*table.columns))


def union_mask(region_cells: DataFrame, name: str) -> DataFrame:
    """Whole-domain mask: every covered cell once."""
    return region_cells.select("iy", "ix").distinct().withColumn("region", F.lit(name)).select("region", "iy", "ix")


def extract_regions(
    cells: DataFrame, region_cells: DataFrame, floats: Sequence[str], keep: Sequence[str], crop: bool = True,
) -> DataFrame:
    """Per-region copies of a cube: floats missing outside the region, integers kept.

    ``crop=True`` limits each copy to the region's bounding box; otherwise only
    the inside cells are returned.
    """
    if not crop:
        return cells.join(region_cells, ["iy", "ix"]).select("region", "t", "iy", "ix", *floats, *keep)
    box = mask_boxes(region_cells)
    frame = (
        box.withColumn("iy", F.explode(F.sequence("iy0", "iy1")))
        .withColumn("ix", F.explode(F.sequence("ix0", "ix1")))
        .select("region", "iy", "ix")
        .join(region_cells.withColumn("inside", F.lit(True)), ["region", "iy", "ix"], "left")
    )
    joined = cells.join(frame, ["iy", "ix"])
    return joined.select("region", "t", "iy", "ix", *[F.when(F.col("inside"), F.col(v)).alias(v) for v in floats], *keep)


def mask_boxes(region_cells: DataFrame) -> DataFrame:
    """Index extent of the cells of each region."""
    return region_cells.groupBy("region").agg(
        F.min("iy").alias("iy0"), F.max("iy").alias("iy1"), F.min("ix").alias("ix0"), F.max("ix").alias("ix1"))


def agree(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, rtol: float = 1e-6) -> DataFrame:
    """Row-wise comparison of two fingerprints; a missing side never agrees."""
    j = left.select(*keys, F.col(value).alias("__a")).join(
        right.select(*keys, F.col(value).alias("__b")), list(keys), "full_outer")
    ok = F.abs(F.col("__a") - F.col("__b")) <= F.lit(rtol) * F.abs("__b")
    return j.select(*keys, F.coalesce(ok, F.lit(False)).alias("agrees"))


def group_shares(df: DataFrame, group: str, value: str, done: DataFrame, key: str) -> DataFrame:
    """Sum per group, the processed part of it (rows whose key is in ``done``), both as shares."""
    marked = df.join(done.select(key).distinct().withColumn("__done", F.lit(1)), key, "left")
    g = marked.groupBy(group).agg(
        F.sum(value).alias("total"), F.coalesce(F.sum(F.when(F.col("__done") == 1, F.col(value))), F.lit(0.0)).alias("part"))
    everything = g.agg(F.sum("total")).scalar()
    return g.withColumns({
        "done_pct": F.try_divide(F.col("part") * 100, F.col("total")),
        "share_pct": F.try_divide(F.col("total") * 100, everything),
    })


def log_bin(value: Column, edges: Sequence[float]) -> Column:
    """Index of the right-closed bin (edge[i], edge[i+1]]; NULL outside."""
    below = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < value))
    return F.when((below >= 1) & (below < len(edges)), below - 1)


def equal_bin(value: Column, lo: Column, hi: Column, n: int) -> Column:
    """Index among ``n`` equal bins; the last bin is closed."""
    raw = F.floor(F.try_divide((value - lo) * n, hi - lo))
    return F.when(value.between(lo, hi), F.least(F.coalesce(raw, F.lit(0)), F.lit(n - 1)))
