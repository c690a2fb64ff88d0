"""Row rules on fields: masks, ramps, conversions, fills, flotation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.projection import transform_box
from fieldspark.model import require_columns, require_rows, when_chain

# Physical constants and thresholds of the rules below.
RHO_ICE = 910.0
RHO_SEA = 1028.0
GRAVITY = 9.80665
KELVIN = 273.15
TAUC_PRIOR = 1.4e5
DEEP_OCEAN = -2000.0
FILL_VALUES = {"air_temp": 260.0, "air_temp_sd": 0.0, "precipitation": 0.0, "orography": 0.0}

ALPHA = 1 - RHO_ICE / RHO_SEA


def select_variables(df: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    require_columns(df, variables)
    return df.select(*keys, *variables)


def split_by_dims(dims: Mapping[str, Sequence[str]], lacking: str = "or", aux: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(spatial, non-spatial) names; ``or``: lacking x or y is non-spatial, ``and``: lacking both."""
    def flat(d):
        return ("x" not in d or "y" not in d) if lacking == "or" else ("x" not in d and "y" not in d)

    kept = {n: d for n, d in dims.items() if n not in aux}
    return [n for n, d in kept.items() if not flat(d)], [n for n, d in kept.items() if flat(d)]


def utm_crs(zone: Column, lat: Column, override: Column | None = None) -> Column:
    code = F.concat(F.lit("EPSG:"), (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone).cast("string"))
    return F.coalesce(override, code) if override is not None else code


def large_outlines(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    return df.where(F.col("area_km2") > threshold)


def in_complex(complex_id: Column, aggregates: Column, wanted: Column) -> Column:
    """Direct parent, or a whole token of the ``;`` list."""
    return (complex_id == wanted) | F.array_contains(F.split(F.coalesce(aggregates, F.lit("")), ";"), wanted)


def is_outline_type(rgi_id: Column, kind: str) -> Column:
    return F.coalesce(rgi_id.contains(f"-{kind}-"), F.lit(False))


def in_id_region(rgi_id: Column, region: str) -> Column:
    return F.coalesce(rgi_id.contains(f"-G-{region}-"), F.lit(False))


def time_window(df: DataFrame, time: str, start, end) -> DataFrame:
    """Closed on both ends; an empty window raises with the covered years."""
    lo, hi = F.lit(start).cast(dict(df.dtypes)[time]), F.lit(end).cast(dict(df.dtypes)[time])
    out = df.where(F.col(time).between(lo, hi))
    if out.isEmpty():
        years = df.agg(F.min(F.year(time)), F.max(F.year(time))).first()
        require_rows(out, f"no steps in {start}..{end}; data covers {years[0]}..{years[1]}")
    return out


def clip_box(
    df: DataFrame, x: tuple[float, float], y: tuple[float, float], box_crs: str | None = None, data_crs: str | None = None,
) -> DataFrame:
    """Bounding box as literal predicates, which reach the Parquet scan; either order of bounds.

    A box in another system than the data's is transformed first, with its edges, to the box around them.
    """
    if box_crs != data_crs:
        corners = [F.lit(float(c)) for c in (min(x), min(y), max(x), max(y))]
        x0, y0, x1, y1 = df.sparkSession.range(1).select(*transform_box(box_crs, data_crs, tuple(corners))).first()
        x, y = (x0, x1), (y0, y1)
    return df.where(F.col("x").between(min(x), max(x)) & F.col("y").between(min(y), max(y)))


def perimeter_by_width(x: Column, y: Column, box: Mapping[str, Column], width: float) -> Column:
    """Strictly closer than ``width`` to an edge of the box."""
    return (x < box["xmin"] + width) | (x > box["xmax"] - width) | (y < box["ymin"] + width) | (y > box["ymax"] - width)


def perimeter_by_count(iy: Column, ix: Column, ny: Column, nx: Column, width: float, dx: float) -> Column:
    """Outermost round(width/dx) rows and columns (half to even)."""
    n = round(width / dx)
    return (iy < n) | (iy >= ny - n) | (ix < n) | (ix >= nx - n)


def ocean_moat(df: DataFrame, moat: Column) -> DataFrame:
    return df.withColumns({
        "surface": F.when(moat, 0.0).otherwise(F.col("surface")),
        "thickness": F.when(moat, 0.0).otherwise(F.col("thickness")),
        "bed": F.when(moat, DEEP_OCEAN).otherwise(F.col("bed"))})


def deep_ocean(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Surface, thickness and bed of the open deep ocean in the given cells, such as those that a polygon touches."""
    marked = cells.select("iy", "ix").distinct().withColumn("__deep", F.lit(True))
    d = df.join(marked, ["iy", "ix"], "left")
    return ocean_moat(d, F.coalesce("__deep", F.lit(False))).drop("__deep")


def region_masks(df: DataFrame, region_cells: DataFrame, mode: str = "glacier") -> DataFrame:
    """land_ice_area_fraction_retreat = inside; ftt_mask = outside, all or none."""
    cells = region_cells.select("iy", "ix").distinct().withColumn("__in", F.lit(1))
    d = df.join(cells, ["iy", "ix"], "left")
    inside = F.coalesce("__in", F.lit(0))
    ftt = {"glacier": 1 - inside, "all": F.lit(1), "none": F.lit(0)}
    if mode not in ftt:
        raise ValueError(f"unknown mask mode {mode!r}: {sorted(ftt)}")
    return d.withColumns({"land_ice_area_fraction_retreat": inside, "ftt_mask": ftt[mode]}).drop("__in")


def till_water(speed: Column) -> Column:
    return F.coalesce(F.when(speed < 100, 0.0).when(speed > 250, 2.0).otherwise(1 + (speed - 100) / 150), F.lit(0.0))


def albedo(net: Column, down: Column) -> Column:
    return F.when(down > 0, 1 - net / down)


def to_kelvin(c: Column) -> Column:
    return c + KELVIN


def to_celsius(c: Column) -> Column:
    return c - KELVIN


def geopotential_height(c: Column) -> Column:
    return c / GRAVITY


def water_equivalent(m: Column) -> Column:
    return m * 1000


def snow_and_rain(snow: Column, rain: Column) -> Column:
    return snow * 1000 + rain


def per_day(per_second: Column) -> Column:
    return per_second * 86400


def heat_flux_watts(milliwatts: Column) -> Column:
    return F.greatest(milliwatts / 1000, F.lit(0.0))


def fill_missing(df: DataFrame, variables: Sequence[str], default: float = 0.0, uniform: bool = False) -> DataFrame:
    """Per-variable fill values; ``uniform`` fills everything with ``default``."""
    return df.withColumns({
        v: F.coalesce(F.nanvl(F.col(v).cast("double"), F.lit(None)), F.lit(default if uniform else FILL_VALUES.get(v, default)))
        for v in variables})


def ocean_rules(kind: str, value: Column) -> Column:
    """Range and missing rules by variable kind; NULL marks cells a nearest fill takes care of."""
    huge = value.between(-1e40, -1e10)
    if kind == "temperature":
        return F.when(value.isNull() | value.between(-1, 1), 260.0).otherwise(value)
    if kind == "salinity":
        return F.when(~value.between(-1, 1), value)
    if kind == "thermal_forcing":
        return value
    return F.coalesce(F.when(~huge, value), F.lit(0.0))


def finite_or_zero(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def floor_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def thickness_and_bed(df: DataFrame) -> DataFrame:
    """Floor thickness, derive the bed, bathymetry where the surface is at or below 0, override bed, zero ice-free surface.

    Columns: surface, thickness, bathymetry, bed_override (NULL outside the outline).
    """
    thk = F.greatest(F.col("thickness"), F.lit(0.0))
    bed = F.when(F.col("surface") <= 0, F.coalesce("bathymetry", F.col("surface") - thk)).otherwise(F.col("surface") - thk)
    d = df.withColumns({"__t": thk, "__b": bed})
    over = F.col("bed_override").isNotNull()
    d = d.withColumns({
        "bed": F.when(over, F.col("bed_override")).otherwise(F.col("__b")),
        "thickness": F.when(over, F.greatest(F.col("surface") - F.col("bed_override"), F.lit(0.0))).otherwise(F.col("__t"))})
    return d.withColumn("surface", F.when(over & (F.col("thickness") <= 0), 0.0).otherwise(F.col("surface"))).drop("__t", "__b")


def flotation_thickness(surface: Column, bed: Column, cls: Column, in_basin: Column) -> Column:
    """Thickness from surface and bed on grounded cells, from flotation on floating ones; thin ice is dropped."""
    s = F.greatest(surface, F.lit(0.0))
    grounded = F.when((s > 0) & (cls == 2), s - bed).otherwise(0.0)
    most = F.greatest(-bed * RHO_SEA / RHO_ICE, F.lit(0.0))
    floating = (s > 0) & cls.isin(0, 3) & in_basin
    thk = F.when(floating, F.least(s / ALPHA, most)).otherwise(grounded)
    return F.when((thk > 10) & in_basin, thk).otherwise(0.0)


def is_grounded(bed: Column, thk: Column, ice_fraction: Column, ice_free: float = 0.01, sea_level: float = 0.0) -> Column:
    return (bed + thk >= sea_level + ALPHA * thk) & (thk > ice_free) & (ice_fraction > 0.5)


def inversion_masks(df: DataFrame, free: Column) -> DataFrame:
    """Weight 1 and mask 0 where the inversion is free, the reverse elsewhere; constant prior."""
    f = F.coalesce(free, F.lit(False))
    return df.withColumns({"vel_misfit_weight": F.when(f, 1).otherwise(0), "zeta_fixed_mask": F.when(f, 0).otherwise(1),
                           "tauc_prior": F.lit(TAUC_PRIOR)})


def observed_velocity(df: DataFrame) -> DataFrame:
    """Zero off ice, speed, missing components as 0, masks from the coverage of ``v``."""
    missing = F.col("v").isNull()
    on_ice = F.coalesce(F.col("landice") == 1, F.lit(False))
    d = df.withColumns({"__free": ~missing, "vx": F.when(on_ice, F.col("vx")).otherwise(0.0), "vy": F.when(on_ice, F.col("vy")).otherwise(0.0)})
    d = d.withColumns({"v": F.hypot("vx", "vy"), "u_observed": F.coalesce("vx", F.lit(0.0)), "v_observed": F.coalesce("vy", F.lit(0.0))})
    return inversion_masks(d, F.col("__free")).drop("__free")


def latitude_ramp(lat: Column, low: tuple[float, float] = (69.0, 228.0), high: tuple[float, float] = (80.0, 10.0),
                  land: Column | None = None) -> Column:
    """Melt rate between two latitudes as mass flux, clipped at both ends; zero on land when given."""
    (a, va), (b, vb) = low, high
    slope = (vb - va) / (b - a)
    melt = F.least(F.greatest((lat - a) * slope + va, F.lit(min(va, vb))), F.lit(max(va, vb))) * RHO_ICE
    return F.when(land, 0.0).otherwise(melt) if land is not None else melt


def offset_series(members: DataFrame, delta_t: str, frac_p: str, step_day: float | None = None, end_day: float = 365.0) -> DataFrame:
    """One-step offset series per member, or two steps around ``step_day`` (no change before it)."""
    dt, fp = F.col(delta_t).cast("double"), F.col(frac_p).cast("double")
    row = lambda a, b, t, p: F.struct(
        F.lit((a + b) / 2 * 86400.0).alias("time"), F.lit(a * 86400.0).alias("start"), F.lit(b * 86400.0).alias("end"),
        t.alias("delta_T"), p.alias("frac_P"))
    if step_day is None:
        steps = [row(0.0, end_day, dt, fp)]
    else:
        steps = [row(0.0, step_day, F.lit(0.0), F.lit(1.0)), row(step_day, end_day, dt, fp)]
    rest = [c for c in members.columns if c not in (delta_t, frac_p)]
    return members.select(*rest, F.inline(F.array(*steps)))


def rule_table(value: Column, variable: Column, rules: Sequence[tuple[str, float, float, float | None]]) -> Column:
    """Replace values inside [lo, hi] per variable; the replacement may be missing."""
    return when_chain([((variable == v) & value.between(lo, hi), F.lit(r).cast("double")) for v, lo, hi, r in rules], value)
