"""Health checks of cubes and distribution specs, as jobs that report per dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _axis(df: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    """Monotonicity of one axis from its distinct (index, value) pairs."""
    axis = df.groupBy(*keys, index).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    step = F.col("__lo") - F.lag("__lo").over(Window.partitionBy(*keys).orderBy(index))  # one row per axis position
    s = axis.withColumn("__step", step)
    up, down = (F.coalesce(F.bool_and(c), F.lit(True)) for c in (F.col("__step") > 0, F.col("__step") < 0))
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), (F.bool_and(F.col("__lo").eqNullSafe(F.col("__hi"))) & (up | down)).alias("__ok"))


def windows(ny: Column, nx: Column, window: int) -> dict[str, Column]:
    """Predicates of the centre and corner windows, clamped to the grid."""
    def span(i: str, n: Column, start: Column) -> Column:
        a = F.greatest(F.lit(0), F.least(start, n - window))
        return (F.col(i) >= a) & (F.col(i) < a + window)

    zero = F.lit(0)
    mid = {"y": span("iy", ny, F.floor(ny / 2)), "x": span("ix", nx, F.floor(nx / 2))}
    lo = {"y": span("iy", ny, zero), "x": span("ix", nx, zero)}
    hi = {"y": span("iy", ny, ny - window), "x": span("ix", nx, nx - window)}
    return {"centre": mid["y"] & mid["x"], "tl": lo["y"] & lo["x"], "tr": lo["y"] & hi["x"], "bl": hi["y"] & lo["x"], "br": hi["y"] & hi["x"]}


def check_cubes(
    df: DataFrame, dataset: str, required: Sequence[str], variables: Sequence[str], time: str = "t", window: int = 32, full: bool = False,
) -> DataFrame:
    """One row per dataset with the list of violated checks (empty when healthy).

    Sampled mode counts cells in five windows at the first and last step;
    ``full`` reads every value and adds a checksum.
    """
    missing = [v for v in required if v not in df.columns]
    ax, ay = _axis(df, [dataset], "ix", "x"), _axis(df, [dataset], "iy", "y")
    size = df.groupBy(dataset).agg(F.max("iy").alias("__ny"), F.max("ix").alias("__nx"), F.min(time).alias("__t0"), F.max(time).alias("__t1"),
                                   F.count_if(F.col(time).isNull()).alias("__bad_time"))
    d = df.join(size, dataset)
    win = windows(F.col("__ny") + 1, F.col("__nx") + 1, window)
    edges = {"first": F.col(time) == F.col("__t0"), "last": F.col(time) == F.col("__t1")}
    counts = [F.count_if(w & e).alias(f"{k}_{n}") for k, w in win.items() for n, e in edges.items()]
    extra = [F.sum(F.xxhash64(*variables).cast("decimal(38,0)")).alias("checksum"), F.count(F.lit(1)).alias("n_rows")] if full else []
    c = d.groupBy(dataset).agg(F.first("__bad_time").alias("bad_time"), *counts, *extra)
    j = c.join(ax.select(dataset, F.col("__n").alias("xn"), F.col("__ok").alias("xok")), dataset).join(
        ay.select(dataset, F.col("__n").alias("yn"), F.col("__ok").alias("yok")), dataset)
    empty = [F.when(F.col(f"{k}_{n}") == 0, F.lit(f"ValueError: window {k}/{n} is empty")) for k in win for n in edges]
    errors = F.array_compact(F.array(
        *[F.lit(f"KeyError: missing variable {m}") for m in missing],
        F.when(F.col("xn") < 2, "ValueError: x has fewer than 2 elements").when(~F.col("xok"), "ValueError: x is not strictly monotonic"),
        F.when(F.col("yn") < 2, "ValueError: y has fewer than 2 elements").when(~F.col("yok"), "ValueError: y is not strictly monotonic"),
        F.when(F.col("bad_time") > 0, "ValueError: time cannot be decoded"), *empty))
    return j.select(dataset, errors.alias("errors"), *(["checksum", "n_rows"] if full else []))


def invalid_datasets(report: DataFrame, dataset: str) -> DataFrame:
    """Rows ``(dataset, error)`` of the failing datasets only."""
    return report.select(dataset, F.explode("errors").alias("error"))


def exit_code(report: DataFrame) -> int:
    """1 when any dataset failed, else 0."""
    return 0 if report.where(F.size("errors") > 0).isEmpty() else 1


def check_specs(specs: DataFrame) -> DataFrame:
    """Violated rules per spec row: ``name, distribution, params MAP, choices ARRAY, weights ARRAY<DOUBLE>``."""
    kind, p = F.lower(F.trim("distribution")), F.col("params")
    has = lambda k: F.coalesce(F.map_contains_key(p, k), F.lit(False))
    num = lambda k: F.try_element_at(p, F.lit(k)).try_cast("double")
    choice, rand, trunc = kind.isin("choices", "choice", "categorical"), kind == "randint", kind == "truncnorm"
    other = kind.isin("uniform", "norm", "lognorm", "expon", "loggamma")
    w = F.col("weights")
    shape = F.when(kind == "lognorm", ~has("s")).when(kind == "loggamma", ~has("c"))
    bad_weight = F.exists(w, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0))
    rules = {
        "unknown distribution": ~(choice | rand | trunc | other),
        "empty choices": choice & (F.coalesce(F.size("choices"), F.lit(0)) <= 0),
        "weights length": choice & w.isNotNull() & (F.size(w) != F.size("choices")),
        "weights value": choice & F.coalesce(bad_weight, F.lit(False)),
        "weights sum": choice & F.coalesce(F.aggregate(w, F.lit(0.0), lambda a, x: a + x) <= 0, F.lit(False)),
        "randint bounds": rand & ~(has("low") & has("high")),
        "truncnorm bounds": trunc & ~((has("a") & has("b")) | (has("lower") & has("upper"))),
        "loc and scale": other & ~(has("loc") & has("scale")),
        "scale": (trunc | other) & F.coalesce(num("scale") <= 0, F.lit(False)),
        "shape": other & F.coalesce(shape, F.lit(False)),
    }
    return specs.select("name", kind.alias("distribution"), F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])).alias("errors"))
