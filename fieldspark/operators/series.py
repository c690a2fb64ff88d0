"""Time series and paths: integrals, bounds, references, resampling, path geometry.

All ordered work goes through :mod:`fieldspark.operators.scan`, so one long
series never sits in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.model import as_col, require_columns, require_rows
from fieldspark.operators import scan

DAY_MICROS = 86_400_000_000
DAYS_PER_YEAR = 365.25
# Days per month of the 365-day calendar.
NOLEAP_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
GT_PER_MM_SEA_LEVEL = 361.8  # fixed value


def days_between(start: Column, end: Column) -> Column:
    """Fractional days between two timestamps."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(DAY_MICROS)


def month_days(day: Column) -> Column:
    """Days in the month, leap years included."""
    return F.day(F.last_day(day))


def integrate_rate(
    df: DataFrame,
    rate: str,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    method: str = "left",
    width: Column | None = None,
    skipna: bool = True,
    per_days: float = 1.0,
    name: str | None = None,
) -> DataFrame:
    """Running integral of a rate; the result column is ``cumulative_<rate>``.

    ``left``: starts at 0, uses rate times the step to the next sample.
    ``trapezoid``: mean of both ends times the step, starts at 0.
    With ``width`` (days per sample) every sample counts and nothing leads.
    ``per_days`` is the length in days of the rate's time unit (365.25 for a
    rate per year).  ``skipna=False`` leaves NULL from the first missing value on.
    """
    require_columns(df, [rate, *keys, *order])
    if method not in ("left", "trapezoid"):
        raise ValueError(f"method must be 'left' or 'trapezoid', got {method!r}")
    out = name or f"cumulative_{rate}"
    r = F.nanvl(F.col(rate).cast("double"), F.lit(None))
    d = df.withColumn("__r", r)
    time = order[0]
    if width is not None:
        inc, extra, inclusive = F.col("__r") * width / per_days, [], True
    elif method == "left":
        d = scan.neighbours(d, keys, order, block, nxt={"__tn": time})
        inc, extra, inclusive = F.col("__r") * days_between(F.col(time), F.col("__tn")) / per_days, ["__tn"], False
    else:
        d = scan.neighbours(d, keys, order, block, prev={"__tp": time, "__rp": "__r", "__has": F.lit(True)})
        inc = (F.col("__r") + F.col("__rp")) / 2 * days_between(F.col("__tp"), F.col(time)) / per_days
        extra, inclusive = ["__tp", "__rp", "__has"], True
    sums = {out: inc}
    if not skipna:
        bad = inc.isNull() if method == "left" or width is not None else inc.isNull() & F.col("__has").isNotNull()
        sums["__bad"] = F.when(bad, 1).otherwise(0)
    d = scan.running(d, keys, order, block, sums, inclusive)
    if not skipna:
        d = d.withColumn(out, F.when(F.col("__bad") == 0, F.col(out)))
    return d.drop("__r", "__bad", *extra)


def time_bounds(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """Bounds (t_i, t_i+1); the last sample of each series is dropped."""
    t = order[0]
    d = scan.neighbours(df, keys, order, block, nxt={"__n": t}).where(F.col("__n").isNotNull())
    return d.withColumn("bounds", F.struct(F.col(t).alias("start"), F.col("__n").alias("end"))).drop("__n")


def month_bounds(df: DataFrame, time: str) -> DataFrame:
    """Bounds [t, first day of the next month); all samples stay."""
    nxt = F.add_months(F.trunc(time, "month"), 1)
    return df.withColumn("bounds", F.struct(F.col(time).alias("start"), nxt.alias("end")))


def subtract_reference(df: DataFrame, values: Sequence[str], time: str, reference: Column, keys: Sequence[str]) -> DataFrame:
    """Subtract each series' value at the time nearest to ``reference`` (earlier one on ties)."""
    require_columns(df, values)
    gap = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(reference.cast("timestamp")))
    ref = df.groupBy(*keys).agg(*[F.min_by(v, F.struct(gap, F.col(time))).alias(f"__ref_{v}") for v in values])
    out = df.join(ref, list(keys)) if keys else df.withColumns(
        {f"__ref_{v}": ref.select(f"__ref_{v}").scalar() for v in values})
    return out.withColumns({v: F.col(v) - F.col(f"__ref_{v}") for v in values}).drop(*[f"__ref_{v}" for v in values])


def change_since_first(df: DataFrame, value: str, time: str, keys: Sequence[str], scale: float = 1.0) -> DataFrame:
    """(v - v at the first time) * scale per series."""
    first = df.groupBy(*keys).agg(F.min_by(value, time).alias("__first"))
    return df.join(first, list(keys)).withColumn(value, (F.col(value) - F.col("__first")) * scale).drop("__first")


def restamp_years(df: DataFrame, year: str, keys: Sequence[str] = ()) -> DataFrame:
    """The n-th kept year becomes year n; ranks the distinct years, not the rows."""
    years = df.select(*keys, year).distinct()
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(year)
    ranked = years.withColumn("__n", F.row_number().over(w))
    return df.join(ranked, [*keys, year]).withColumn(year, F.col("__n")).drop("__n")


def trim_and_resample(
    df: DataFrame, values: Sequence[str], keys: Sequence[str], after_year: int, until_year: int, year: str = "year",
) -> DataFrame:
    """Drop spin-up years (<= after_year), average by year, restamp as years 1..n."""
    kept = df.where((F.col(year) > after_year) & (F.col(year) <= until_year))
    annual = kept.groupBy(*keys, year).agg(*[F.avg(v).alias(v) for v in values])
    return restamp_years(annual, year)


def adjusted_series(
    df: DataFrame, values: Sequence[str], cumulative: Sequence[str], keys: Sequence[str], after_year: int, until_year: int,
    year: str = "year",
) -> DataFrame:
    """Window, annual means, restamp; cumulative variables relative to their first kept year."""
    require_columns(df, [*values, *cumulative])
    annual = trim_and_resample(df, values, keys, after_year, until_year, year)
    require_rows(annual, f"no steps between years {after_year} and {until_year}")
    ref = annual.where(F.col(year) == 1).select(*keys, *[F.col(c).alias(f"__r_{c}") for c in cumulative])
    out = annual.join(ref, list(keys), "left")
    return out.withColumns({c: F.col(c) - F.col(f"__r_{c}") for c in cumulative}).drop(*[f"__r_{c}" for c in cumulative])


def window_means(df: DataFrame, year: str, value: str, keys: Sequence[str], ends: Sequence[int], span: int = 10) -> DataFrame:
    """Mean over [end-span, end] for each labelled end year; windows may overlap."""
    hits = F.array_compact(F.array(*[F.when(F.col(year).between(e - span, e), F.lit(e)) for e in ends]))
    return (df.select(*keys, value, F.explode(hits).alias("window_end"))
            .groupBy(*keys, "window_end").agg(F.avg(value).alias(value)))


def periodic_month_axis(df: DataFrame, month: str = "month", keys: Sequence[str] = ()) -> DataFrame:
    """Start, end and midpoint day of each month on a 365-day year; all 12 months are required."""
    per_key = df.groupBy(*keys).agg(F.count_distinct(month).alias("n"))
    short = per_key.where(F.col("n") != 12).limit(1).count()
    if short:
        raise ValueError("a monthly climatology needs exactly 12 months")
    ends = [sum(NOLEAP_DAYS[: i + 1]) for i in range(12)]
    end = F.element_at(F.array(*[F.lit(float(e)) for e in ends]), F.col(month).cast("int"))
    days = F.element_at(F.array(*[F.lit(float(d)) for d in NOLEAP_DAYS]), F.col(month).cast("int"))
    return df.withColumns({"start_day": end - days, "end_day": end, "mid_day": end - days / 2})


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of every key, as an aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(packed).select(*keys, "__row.*")


def label_index(df: DataFrame, label: str, order: str) -> DataFrame:
    """Replace string labels by a 0-based index in input order, name kept as ``<label>_name``."""
    if dict(df.dtypes)[label] != "string":
        return df
    firsts = df.groupBy(label).agg(F.min(order).alias("__o"))
    w = Window.partitionBy(F.lit(0)).orderBy("__o")
    names = firsts.select(label, (F.row_number().over(w) - 1).alias("__i"))
    out = df.join(names, label).withColumn(f"{label}_name", F.col(label)).withColumn(label, F.col("__i"))
    return out.drop("__i")


# ---------------------------------------------------------------- paths


def path_vectors(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Unit normals and tangents along ordered points; ends are one-sided, zero length stays 0."""
    d = scan.neighbours(df, keys, order, block, prev={"__xp": x, "__yp": y}, nxt={"__xn": x, "__yn": y})
    tx = F.coalesce("__xn", x) - F.coalesce("__xp", x)
    ty = F.coalesce("__yn", y) - F.coalesce("__yp", y)
    d = d.withColumns({"__tx": tx, "__ty": ty})
    length = F.hypot("__tx", "__ty")
    unit = lambda c: F.when(length > 0, c / length).otherwise(0.0)
    d = d.withColumns({"tx": unit(F.col("__tx")), "ty": unit(F.col("__ty")),
                       "nx": unit(F.col("__ty")), "ny": unit(-F.col("__tx"))})
    return d.drop("__xp", "__yp", "__xn", "__yn", "__tx", "__ty")


def path_coordinate(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, chord: bool = False, x: str = "x", y: str = "y",
) -> DataFrame:
    """Profile axis: running sum of position norms minus the first, or chord length with ``chord``."""
    if chord:
        d = scan.neighbours(df, keys, order, block, prev={"__xp": x, "__yp": y})
        step = F.coalesce(F.hypot(F.col(x) - F.col("__xp"), F.col(y) - F.col("__yp")), F.lit(0.0))
        return scan.running(d, keys, order, block, {"axis": step}).drop("__xp", "__yp")
    norm = F.hypot(x, y)
    d = scan.running(df, keys, order, block, {"axis": norm})
    first = df.groupBy(*keys).agg(F.min_by(norm, F.struct(*order)).alias("__f"))
    return d.join(first, list(keys)).withColumn("axis", F.col("axis") - F.col("__f")).drop("__f")


def path_integral(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, axis: str, values: Sequence[str]) -> DataFrame:
    """Trapezoid integral of each value along ``axis``, one row per path."""
    d = scan.neighbours(df, keys, order, block, prev={"__ap": axis, **{f"__p_{v}": v for v in values}})
    return d.groupBy(*keys).agg(*[
        F.coalesce(F.sum((F.col(v) + F.col(f"__p_{v}")) / 2 * (F.col(axis) - F.col("__ap"))), F.lit(0.0)).alias(f"{v}_flux")
        for v in values])


def profile_statistics(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, axis: str, obs: str, sim: str) -> DataFrame:
    """RMSD, Pearson r and both fluxes per profile."""
    diff = F.col(sim) - F.col(obs)
    both = F.col(obs).isNotNull() & F.col(sim).isNotNull()
    stats = df.groupBy(*keys).agg(
        F.sqrt(F.avg(diff * diff)).alias("rmsd"),
        F.corr(F.when(both, F.col(obs)), F.when(both, F.col(sim))).alias("pearson_r"))
    return stats.join(path_integral(df, keys, order, block, axis, [obs, sim]), list(keys))


def normal_component(vx: str | Column, vy: str | Column) -> Column:
    """Projection of a vector onto the path normal."""
    return as_col(vx) * F.col("nx") + as_col(vy) * F.col("ny")


def curvature_corner(df: DataFrame, keys: Sequence[str], penalty: str, misfit: str, norm: str, block: Column) -> DataFrame:
    """Corner of the trade-off curve: greatest Menger curvature of consecutive log10 triples."""
    lx, ly = F.log10(norm), F.log10(misfit)
    d = scan.neighbours(df.withColumns({"__x": lx, "__y": ly}), keys, [penalty], block,
                        prev={"__x0": "__x", "__y0": "__y"}, nxt={"__x2": "__x", "__y2": "__y"})
    a = F.hypot(F.col("__x") - F.col("__x0"), F.col("__y") - F.col("__y0"))
    b = F.hypot(F.col("__x2") - F.col("__x"), F.col("__y2") - F.col("__y"))
    c = F.hypot(F.col("__x2") - F.col("__x0"), F.col("__y2") - F.col("__y0"))
    cross = F.abs((F.col("__x") - F.col("__x0")) * (F.col("__y2") - F.col("__y0"))
                  - (F.col("__y") - F.col("__y0")) * (F.col("__x2") - F.col("__x0")))
    k = F.try_divide(2 * cross, a * b * c)
    d = d.where(F.col("__x0").isNotNull() & F.col("__x2").isNotNull()).withColumn("curvature", k)
    best = F.max_by(F.struct(penalty, "curvature"), F.struct(F.col("curvature"), -F.col(penalty)))
    return d.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")
