"""Resampling, remapping, mosaics and gap filling on cell tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.outlines import Grid


def bilinear(
    targets: DataFrame, source: DataFrame, values: Sequence[str], grid: Grid = Grid(), target_keys: Sequence[str] = ("ty", "tx"),
    slices: Sequence[str] = (), renormalise: bool = True,
) -> DataFrame:
    """Bilinear resampling of ``source`` at ``targets`` (columns ``sx, sy`` in source coordinates).

    Every target is returned, for every distinct combination of ``slices`` in the
    source; targets that the source does not cover are missing.
    Each target meets its four neighbours through an equality join; Spark takes
    the exploded neighbours for no larger than the targets' file, so that side
    asks for a merge join and is never broadcast.  Missing neighbours are left out and weights renormalised; with
    ``renormalise=False`` one missing neighbour makes the result missing.
    """
    t = targets.withColumns({"__u": grid.col_of(F.col("sx")) - 0.5, "__v": grid.row_of(F.col("sy")) - 0.5})
    t = t.withColumns({"__i": F.floor("__u"), "__j": F.floor("__v")})
    fu, fv = F.col("__u") - F.col("__i"), F.col("__v") - F.col("__j")
    corner = lambda dj, di, w: F.struct((F.col("__j") + dj).alias("iy"), (F.col("__i") + di).alias("ix"), w.alias("w"))
    four = F.array(corner(0, 0, (1 - fu) * (1 - fv)), corner(0, 1, fu * (1 - fv)),
                   corner(1, 0, (1 - fu) * fv), corner(1, 1, fu * fv))
    w = t.select(*target_keys, F.inline(four)).where(F.col("w") > 0)
    s = source.select("iy", "ix", *slices, *[F.nanvl(F.col(v).cast("double"), F.lit(None)).alias(v) for v in values])
    hit = w.hint("merge").join(s, ["iy", "ix"])
    aggs = []
    for v in values:
        wv = F.sum(F.when(F.col(v).isNotNull(), F.col("w")))
        mean = F.sum(F.col("w") * F.col(v)) / wv
        aggs.append((mean if renormalise else F.when(wv > 1 - 1e-9, mean)).alias(v))
    out = hit.groupBy(*target_keys, *slices).agg(*aggs)
    frame = targets.select(*target_keys)
    if slices:
        frame = every_slice(frame, source, slices)
    return frame.join(out, [*target_keys, *slices], "left")


def every_slice(targets: DataFrame, source: DataFrame, slices: Sequence[str]) -> DataFrame:
    """The targets once for every distinct combination of ``slices``: copied to the numbers of these, which meet them by a join."""
    steps = source.select(*slices).distinct()
    numbered = steps.withColumn("__k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*slices)))  # the slices alone, one row each
    n = steps.agg(F.count(F.lit(1)).cast("int")).scalar()
    copies = targets.withColumn("__k", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
    return copies.join(F.broadcast(numbered), "__k").drop("__k")  # the few slices, not their copies, whose number Spark does not foresee


def _overlaps(lo: Column, hi: Column, start: float, step: float) -> Column:
    """Target intervals met by [lo, hi) with the overlap lengths."""
    first, last = F.floor((lo - start) / step), F.ceil((hi - start) / step) - 1
    return F.transform(F.sequence(first, last), lambda k: F.struct(
        k.alias("k"), (F.least(hi, start + (k + 1) * step) - F.greatest(lo, start + k * step)).alias("w")))


def conservative(
    source: DataFrame, values: Sequence[str], src: Grid, dst: Grid, slices: Sequence[str] = (),
) -> DataFrame:
    """Area-weighted mean onto another regular grid of the same CRS: ``(ty, tx, values)``.

    Each source cell spreads to the targets it overlaps (separable 1-D
    overlaps), so the job is one partially aggregated shuffle and no join.
    """
    x0, y0 = F.col("ix") * src.dx + src.x0, F.col("iy") * src.dy + src.y0
    spread = (
        source.select(*slices, *values, F.explode(_overlaps(y0, y0 + src.dy, dst.y0, dst.dy)).alias("__oy"),
                      _overlaps(x0, x0 + src.dx, dst.x0, dst.dx).alias("__xs"))
        .select(*slices, *values, "__oy", F.explode("__xs").alias("__ox"))
        .withColumns({"ty": F.col("__oy.k"), "tx": F.col("__ox.k"), "__w": F.col("__oy.w") * F.col("__ox.w")})
        .where(F.col("__w") > 1e-12)
    )
    ok = {v: F.nanvl(F.col(v).cast("double"), F.lit(None)) for v in values}
    return spread.groupBy(*slices, "ty", "tx").agg(*[
        F.try_divide(F.sum(F.col("__w") * c), F.sum(F.when(c.isNotNull(), F.col("__w")))).alias(v) for v, c in ok.items()])


def supersample(targets: DataFrame, k: int, cx: str = "cx", cy: str = "cy", dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """k x k evenly spread points per target cell (columns ``px, py``), for remaps across CRSs.

    The targets are dealt over the shuffle partitions first: a small file of them would become one task of all points.
    """
    targets = targets.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), cx, cy)
    off = [(i + 0.5) / k - 0.5 for i in range(k)]
    pts = F.array(*[F.struct((F.col(cx) + a * dx).alias("px"), (F.col(cy) + b * dy).alias("py")) for b in off for a in off])
    return targets.select("*", F.inline(pts))


def nearest_mean(points: DataFrame, source: DataFrame, values: Sequence[str], grid: Grid, keys: Sequence[str]) -> DataFrame:
    """Mean over a target's points of the source cell each point falls into."""
    p = points.withColumns({"iy": F.floor(grid.row_of(F.col("py"))), "ix": F.floor(grid.col_of(F.col("px")))})
    n = p.groupBy(*keys, "iy", "ix").agg(F.count(F.lit(1)).alias("__n"))
    j = n.hint("merge").join(source.select("iy", "ix", *values), ["iy", "ix"])  # Spark does not foresee the number of points
    return j.groupBy(*keys).agg(*[
        F.try_divide(F.sum(F.col("__n") * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col("__n")))).alias(v) for v in values])


def majority(source: DataFrame, cls: str, src: Grid, dst: Grid, slices: Sequence[str] = ()) -> DataFrame:
    """Most frequent class among the source centres in each target cell, lowest class on ties."""
    ty = F.floor(((F.col("iy") + 0.5) * src.dy + src.y0 - dst.y0) / dst.dy)
    tx = F.floor(((F.col("ix") + 0.5) * src.dx + src.x0 - dst.x0) / dst.dx)
    n = source.groupBy(*slices, ty.alias("ty"), tx.alias("tx"), cls).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*slices, "ty", "tx").agg(F.max_by(cls, F.struct(F.col("__n"), -F.col(cls))).alias(cls))


def mosaic(tiles: DataFrame, value: str, rule: str, order: str | None = None, keys: Sequence[str] = ("iy", "ix")) -> DataFrame:
    """Merge overlapping rasters: ``max`` (0 is no data), ``first`` by ``order``, or ``sum``."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    if rule == "max":
        agg = F.max(F.when(v != 0, v))
    elif rule == "first":
        agg = F.min_by(v, F.when(v.isNotNull(), F.col(order)))
    elif rule == "sum":
        agg = F.sum(v)
    else:
        raise ValueError(f"unknown mosaic rule {rule!r}: max, first or sum")
    return tiles.groupBy(*keys).agg(agg.alias(value))


def two_phase_mosaic(tiles: DataFrame, value: str, region_cells: DataFrame, membership: DataFrame) -> DataFrame:
    """Mosaic per complex, then per aggregate over its complexes' results, in one plan."""
    one = mosaic(tiles.join(region_cells, ["iy", "ix"]), value, "max", keys=("region", "iy", "ix"))
    two = mosaic(one.join(membership.select("region", "aggregate"), "region"), value, "max", keys=("aggregate", "iy", "ix"))
    return one.unionByName(two.withColumnRenamed("aggregate", "region"))
