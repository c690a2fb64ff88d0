"""Climatologies and field means; all are partially aggregated group-bys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.series import NOLEAP_DAYS


def month_length(month: Column) -> Column:
    """Days of a month in the 365-day calendar."""
    return F.element_at(F.array(*[F.lit(d) for d in NOLEAP_DAYS]), month.cast("int"))


def monthly_climatology(
    df: DataFrame, values: Sequence[str], years: Sequence[int], keys: Sequence[str] = ("iy", "ix"), dtype: str = "float",
    static: DataFrame | None = None, check: bool = True,
) -> DataFrame:
    """Mean by month of the year over a fixed set of years; static fields pass through.

    Raises unless the selected years cover all 12 months.
    """
    kept = df.where(F.col("year").isin([int(y) for y in years]))
    if check and kept.select("month").distinct().count() != 12:
        raise ValueError("the selected years do not cover all 12 months")
    out = kept.groupBy("month", *keys).agg(*[F.avg(v).cast(dtype).alias(v) for v in values])
    return out.join(static, list(keys), "left") if static is not None else out


def period_climatology(
    df: DataFrame, periods: Mapping[str, tuple[int, int]], keys: Sequence[str], mean: Sequence[str], spread: Sequence[str] = (),
    rate: Sequence[str] = (),
) -> DataFrame:
    """Per (period, month): means, population spread, and monthly totals as a daily rate."""
    labels = F.array_compact(F.array(*[
        F.when(F.col("year").between(a, b), F.lit(name)) for name, (a, b) in periods.items()]))
    d = df.select(*keys, "month", F.explode(labels).alias("period"), *dict.fromkeys([*mean, *spread, *rate]))
    return d.groupBy("period", "month", *keys).agg(
        *[F.avg(v).alias(v) for v in mean], *[F.stddev_pop(v).alias(f"{v}_sd") for v in spread],
        *[(F.avg(v) / F.first(month_length(F.col("month")))).alias(f"{v}_rate") for v in rate])


def daily_to_monthly(daily: DataFrame, day: str, keys: Sequence[str], values: Sequence[str], monthly: DataFrame | None = None) -> DataFrame:
    """Monthly mean and divide-by-n spread of daily fields, joined with fields that are monthly already."""
    out = daily.groupBy(F.trunc(day, "month").alias("month"), *keys).agg(
        *[F.avg(v).alias(v) for v in values], *[F.stddev_pop(v).alias(f"{v}_sd") for v in values])
    return out.join(monthly, ["month", *keys]) if monthly is not None else out


def time_mean(df: DataFrame, time: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean over all steps at the mean time, with bounds [first, last + 1 month)."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return df.groupBy(*keys).agg(
        *[F.avg(v).alias(v) for v in values],
        F.avg(us / 86_400_000_000).alias("mean_day"),
        F.min(time).alias("start"), F.add_months(F.max(time), 1).alias("end"))


def season_means(df: DataFrame, keys: Sequence[str], value: str, experiment: str, reference) -> DataFrame:
    """DJF, JJA and annual means of a 12-month climatology, minus the reference experiment, which is dropped."""
    seasons = F.array_compact(F.array(
        F.lit("annual"), F.when(F.col("month").isin(1, 2, 12), F.lit("DJF")), F.when(F.col("month").isin(6, 7, 8), F.lit("JJA"))))
    m = df.select(experiment, *keys, value, F.explode(seasons).alias("season")).groupBy(experiment, "season", *keys).agg(F.avg(value).alias(value))
    ref = m.where(F.col(experiment) == reference).select("season", *keys, F.col(value).alias("__r"))
    return (m.where(F.col(experiment) != reference).join(ref, ["season", *keys])
            .withColumn(value, F.col(value) - F.col("__r")).drop("__r"))


def integrated_total(df: DataFrame, value: str, keys: Sequence[str], cell_keys: Sequence[str], area: float, factor: float) -> DataFrame:
    """Time mean per cell, times cell area and unit factor, summed over cells."""
    mean = df.groupBy(*keys, *cell_keys).agg(F.avg(value).alias("__m"))
    return mean.groupBy(*keys).agg((F.sum("__m") * F.lit(area * factor)).alias("total"))
