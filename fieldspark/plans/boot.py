"""Boot fields: terrain, thickness, bathymetry, velocity and masks in one per-cell table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import rules
from fieldspark.operators import align, regrid
from fieldspark.operators.outlines import Grid


def boot_fields(
    targets: DataFrame, surface: DataFrame, thickness: DataFrame, bathymetry: DataFrame, velocity: DataFrame, outline_cells: DataFrame,
    moat: Column | None = None, forcing_mask: str = "glacier", grid: Grid = Grid(), fallback_surface: DataFrame | None = None,
    bed_override: DataFrame | None = None, deep_ocean: DataFrame | None = None,
) -> DataFrame:
    """One row per target cell (``iy, ix, sx, sy``) with all fields an ice-flow run starts from.

    Each source is resampled once; layers then meet on (iy, ix), thickness is
    limited to the outline, and the rules of bed, moat, masks, till water and
    velocities follow as column expressions.  ``bed_override`` is a source whose bed replaces the derived one
    inside the outline, ``deep_ocean`` cells that no ice may enter.
    """
    keys = ["iy", "ix"]
    t = targets.select(F.col("iy").alias("ty"), F.col("ix").alias("tx"), "sx", "sy")

    def layer(src: DataFrame, values: list[str]) -> DataFrame:
        out = regrid.bilinear(t, src, values, grid)
        return out.withColumnsRenamed({"ty": "iy", "tx": "ix"})

    s = layer(surface, ["surface"])
    if fallback_surface is not None:
        s = align.fill_from(s, layer(fallback_surface, ["surface"]), keys, ["surface"])
    inside = outline_cells.select(*keys).distinct()
    h = layer(thickness, ["thickness"]).join(inside, keys, "left_semi")
    d = s.join(h, keys, "left").join(layer(bathymetry, ["bathymetry"]), keys, "left").join(layer(velocity, ["vx", "vy"]), keys, "left")
    if bed_override is None:
        d = d.withColumn("bed_override", F.lit(None).cast("double"))
    else:
        d = d.join(layer(bed_override, ["bed_override"]).join(inside, keys, "left_semi"), keys, "left")
    d = d.withColumns({"surface": F.coalesce("surface", F.lit(0.0)), "thickness": F.coalesce("thickness", F.lit(0.0))})
    d = rules.thickness_and_bed(d)
    if moat is not None:
        d = rules.ocean_moat(d, moat)
    if deep_ocean is not None:
        d = rules.deep_ocean(d, deep_ocean)
    d = rules.region_masks(d, outline_cells, forcing_mask)
    d = d.withColumn("speed", F.hypot("vx", "vy"))
    d = d.withColumn("tillwat", rules.till_water(F.col("speed")))
    d = d.withColumns({"v": F.col("speed"), "landice": F.when(F.col("thickness") > 0, 1).otherwise(0)})
    return rules.observed_velocity(d).drop("bed_override", "speed", "landice", "bathymetry")
