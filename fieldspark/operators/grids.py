"""Grid construction and aligned bounds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def create_domain(spark: SparkSession, x: Sequence[float], y: Sequence[float], resolution: float | None = None) -> DataFrame:
    """Cell centres and bounds of a regular grid; without resolution one cell covers everything.

    Cells come from one row range, split over tasks, so no axis product is formed.
    """
    nx = 1 if resolution is None else max(1, round((x[1] - x[0]) / resolution))
    ny = 1 if resolution is None else max(1, round((y[1] - y[0]) / resolution))
    dx, dy = (x[1] - x[0]) / nx, (y[1] - y[0]) / ny
    d = spark.range(nx * ny).select(F.floor(F.col("id") / nx).alias("iy"), (F.col("id") % nx).alias("ix"))
    x0, y0 = F.lit(float(x[0])) + F.col("ix") * dx, F.lit(float(y[0])) + F.col("iy") * dy
    return d.withColumns({"x": x0 + dx / 2, "y": y0 + dy / 2, "x_lo": x0, "x_hi": x0 + dx, "y_lo": y0, "y_hi": y0 + dy})


def cell_boxes(cells: DataFrame) -> DataFrame:
    """Ring of corner points per cell, for outline operators."""
    p = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return cells.withColumn("points", F.array(p("x_lo", "y_lo"), p("x_hi", "y_lo"), p("x_hi", "y_hi"), p("x_lo", "y_hi")))


def covering_range(df: DataFrame, axis: str, step: float, keys: Sequence[str] = ()) -> DataFrame:
    """Centre, half width and count of the ``step`` grid that covers a uniform axis, half cells included."""
    pts = df.select(*keys, axis).distinct()
    g = pts.groupBy(*keys).agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"), F.count(F.lit(1)).alias("k"))
    old = F.try_divide(F.col("hi") - F.col("lo"), F.col("k") - 1)
    n = F.ceil((old + F.col("hi") - F.col("lo")) / step)
    return g.select(*keys, ((F.col("lo") + F.col("hi")) / 2).alias("centre"), (n * step / 2).alias("half_width"), n.cast("bigint").alias("n"))


def common_step(base: int, multipliers: Sequence[int]) -> int:
    """Least common multiple of the wanted resolutions."""
    return math.lcm(*[base * m for m in multipliers])


def inward_bounds(xmin: Column, xmax: Column, ymin: Column, ymax: Column, step: float, buffer: float = 0.0) -> list[Column]:
    """Buffered box rounded inwards to multiples of ``step``."""
    up = lambda c: F.ceil((c - buffer) / step) * step
    down = lambda c: F.floor((c + buffer) / step) * step
    return [up(xmin).alias("xmin"), down(xmax).alias("xmax"), up(ymin).alias("ymin"), down(ymax).alias("ymax")]
