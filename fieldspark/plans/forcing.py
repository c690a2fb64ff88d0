"""Forcing builders: clip, resample, fill, convert and stamp, composed of the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import rules
from fieldspark.operators import align, climatology, distance, regrid
from fieldspark.operators import series
from fieldspark.operators.outlines import Grid
from fieldspark.sources import sinks

Builder = Callable[..., DataFrame]
BUILDERS: dict[str, Builder] = {}


def builder(name: str) -> Callable[[Builder], Builder]:
    def add(fn: Builder) -> Builder:
        BUILDERS[name] = fn
        return fn

    return add


def build(name: str, *args, **kwargs) -> DataFrame:
    """Run a registered builder; unknown names raise with the list."""
    if name not in BUILDERS:
        raise KeyError(f"unknown forcing {name!r}; available: {sorted(BUILDERS)}")
    return BUILDERS[name](*args, **kwargs)


def on_grid(source: DataFrame, targets: DataFrame, values: Sequence[str], slices: Sequence[str], box: tuple | None, grid: Grid) -> DataFrame:
    """Clip in source coordinates, resample, fill per variable."""
    if box is not None:
        source = rules.clip_box(source, *box)
    out = regrid.bilinear(targets, source, values, grid, slices=slices)
    return rules.fill_missing(out, values)


@builder("monthly_series")
def monthly_series(source: DataFrame, targets: DataFrame, years: range, box=None, grid: Grid = Grid(), secondary: DataFrame | None = None) -> DataFrame:
    """Temperature to Celsius, precipitation to kg m-2 day-1, one step per month with bounds; missing years take the nearest one."""
    slices = ["year", "month"]
    if secondary is not None:
        source = align.fill_from(source, secondary, [*slices, "iy", "ix"], ["air_temp", "precipitation"])
    f = on_grid(source, targets, ["air_temp", "precipitation"], slices, box, grid)
    owner = align.nearest_year_owner(f, "year", years.start, years.stop - 1)
    f = f.join(owner, F.col("year") == F.col("source_year")).drop("year", "source_year")
    f = f.withColumns({"air_temp": rules.to_celsius(F.col("air_temp")), "precipitation": rules.per_day(F.col("precipitation")),
                       "time": F.make_date("target_year", "month", F.lit(1))})
    return series.month_bounds(f.drop("target_year", "month"), "time")


@builder("climatology")
def monthly_mean(source: DataFrame, targets: DataFrame, years: range, box=None, grid: Grid = Grid()) -> DataFrame:
    """Monthly climatology over ``years`` on the target grid with the periodic axis; ``box`` clips the source first."""
    if box is not None:
        source = rules.clip_box(source, *box)
    c = climatology.monthly_climatology(source, ["air_temp", "precipitation"], list(years), dtype="double")
    return series.periodic_month_axis(on_grid(c, targets, ["air_temp", "precipitation"], ["month"], None, grid))


@builder("time_mean")
def time_mean(source: DataFrame, targets: DataFrame, years: range, box=None, grid: Grid = Grid()) -> DataFrame:
    """One snapshot at the mean time."""
    s = source.where(F.col("year").between(years.start, years.stop - 1)).withColumn("time", F.make_date("year", "month", F.lit(1)))
    m = climatology.time_mean(s, "time", ["iy", "ix"], ["air_temp", "precipitation"])
    return on_grid(m, targets, ["air_temp", "precipitation"], [], box, grid)


@builder("elevation_dependent")
def elevation_dependent(source: DataFrame, targets: DataFrame, *_args, **_kwargs) -> DataFrame:
    """The parameterised climate needs no field: the bare target cells."""
    return targets.select("ty", "tx")


@builder("climatology_with_spread")
def climatology_with_spread(source: DataFrame, targets: DataFrame, years: range, box=None, grid: Grid = Grid()) -> DataFrame:
    """Monthly mean temperature, its standard deviation and mean precipitation over ``years`` on the target grid."""
    if box is not None:
        source = rules.clip_box(source, *box)
    s = source.where(F.col("year").between(years.start, years.stop - 1))
    m = s.groupBy("month", "iy", "ix").agg(F.avg("air_temp").alias("air_temp"), F.stddev_pop("air_temp").alias("air_temp_sd"), F.avg("precipitation").alias("precipitation"))
    return series.periodic_month_axis(on_grid(m, targets, ["air_temp", "air_temp_sd", "precipitation"], ["month"], None, grid))


@builder("series_with_orography")
def series_with_orography(source: DataFrame, targets: DataFrame, years: range, orography: DataFrame, box=None, grid: Grid = Grid(),
                          secondary: DataFrame | None = None) -> DataFrame:
    """The monthly series with the source's static orography (iy, ix, x, y, orography) resampled to the same cells."""
    fields = monthly_series(source, targets, years, box, grid, secondary)
    height = on_grid(orography, targets, ["orography"], [], box, grid)
    return fields.join(height, ["ty", "tx"])


def merge_forcings(
    fields: DataFrame, renames: Mapping[str, str], kinds: Mapping[str, str], annual: Sequence[str], keys: Sequence[str] = ("gcm", "pathway", "forcing"),
) -> tuple[DataFrame, DataFrame]:
    """(monthly, annual) merged forcings from one scan of ``keys, variable, year, month, iy, ix, value``.

    Variables are renamed, cleaned by kind, and pivoted by conditional
    aggregation, so all files of all models merge in one shuffle per cadence.
    Missing salinity and thermal forcing take the nearest valid cell of their step; the fill reads
    its field several times, so a pivot with such variables is written once.
    """
    names = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    d = fields.withColumns({"name": F.try_element_at(names, F.col("variable")), "kind": F.try_element_at(kind, F.col("variable"))}).where("name is not null")
    v: Column = F.nanvl(F.col("value").cast("double"), F.lit(None))
    clean = F.coalesce(*[F.when(F.col("kind") == k, rules.ocean_rules(k, v)) for k in ("temperature", "salinity", "thermal_forcing")],
                       F.when(~F.coalesce(F.col("kind").isin("temperature", "salinity", "thermal_forcing"), F.lit(False)), rules.ocean_rules("other", v)))
    d = d.withColumn("value", clean)
    slow = [renames[a] for a in annual]
    fast = [n for n in renames.values() if n not in slow]
    pivot = lambda g, cols: d.where(F.col("name").isin(cols)).groupBy(*keys, *g, "iy", "ix").agg(
        *[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in cols])
    monthly, yearly = pivot(["year", "month"], fast), pivot(["year"], slow)
    near = [renames[x] for x, k in kinds.items() if k in ("salinity", "thermal_forcing") and x in renames]
    for_fast, for_slow = [n for n in near if n in fast], [n for n in near if n in slow]
    if for_fast:
        monthly = sinks.write_and_read(fields.sparkSession, monthly, "monthly")
        monthly = distance.fill_gaps(monthly, for_fast, slices=[*keys, "year", "month"])
    if for_slow:
        yearly = sinks.write_and_read(fields.sparkSession, yearly, "yearly")
        yearly = distance.fill_gaps(yearly, for_slow, slices=[*keys, "year"])
    return monthly, yearly


