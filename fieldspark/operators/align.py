"""Joins that line data up: as-of, reference, anomaly, fill and merge joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators import distance, regrid, scan
from fieldspark.operators.outlines import Grid


def interpolate_onto(
    sim: DataFrame, obs: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], block: Column
) -> DataFrame:
    """Linear interpolation of ``sim`` onto the times of ``obs``; NULL outside the range.

    Both timelines are merged and the bracketing samples come from block-wise
    fills, so no (obs, sim) pairs are formed.
    """
    rest = [c for c in obs.columns if c not in (*keys, time)]
    node = F.struct(F.col(time).alias("t"), *values)
    s = sim.select(*keys, time, node.alias("__node"))
    o = obs.select(*keys, time, F.struct(*rest).alias("__obs"))
    both = s.unionByName(o, allowMissingColumns=True).withColumn("__isobs", F.col("__obs").isNotNull())
    # sim rows sort before obs rows of the same time, and NULL-safe fills look both ways
    filled = scan.fill_both(both, keys, [time, "__isobs"], block, {"__lo": F.col("__node")}, {"__hi": F.col("__node")})
    us = lambda c: F.unix_micros(c.cast("timestamp")) if dict(sim.dtypes)[time] in ("timestamp", "timestamp_ntz", "date") else c
    t, lo, hi = us(F.col(time)), F.col("__lo"), F.col("__hi")
    exact = us(lo["t"]) == t
    out = {}
    for v in values:
        step = F.try_divide((hi[v] - lo[v]) * (t - us(lo["t"])), us(hi["t"]) - us(lo["t"]))
        out[v] = F.when(exact, lo[v]).otherwise(lo[v] + step)
    return filled.where("__isobs").withColumns(out).select(*keys, time, "__obs.*", *values)


def subtract_baseline(df: DataFrame, baseline: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """df - baseline on common keys only (inner), broadcast over the other dimensions."""
    b = baseline.select(*keys, *[F.col(v).alias(f"__b_{v}") for v in values])
    out = df.join(b, list(keys)).withColumns({v: F.col(v) - F.col(f"__b_{v}") for v in values})
    return out.drop(*[f"__b_{v}" for v in values])


def add_anomaly(baseline: DataFrame, anomaly: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Baseline plus anomaly for ``values``; other baseline columns are copied."""
    a = anomaly.select(*keys, *[c for c in anomaly.columns if c not in (*keys, *values)],
                       *[F.col(v).alias(f"__a_{v}") for v in values])
    out = baseline.join(a, list(keys)).withColumns({v: F.col(v) + F.col(f"__a_{v}") for v in values})
    return out.drop(*[f"__a_{v}" for v in values])


def on_target_cells(
    df: DataFrame, targets: DataFrame, slices: Sequence[str], values: Sequence[str], grid: Grid = Grid(),
) -> DataFrame:
    """``df`` resampled to ``targets`` (ty, tx, sx, sy), as cells (iy, ix); targets without cover take the nearest covered one."""
    out = regrid.bilinear(targets, df, values, grid, slices=slices).withColumnsRenamed({"ty": "iy", "tx": "ix"})
    return distance.fill_gaps(out, values, slices=slices)


def pair_difference(df: DataFrame, pairs: DataFrame, scenario: str, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """future - present for every (model, future, present) pair, on common keys."""
    v = df.select(scenario, *keys, *[c.alias(n) for n, c in values.items()])
    fut = v.withColumnsRenamed({scenario: "future", **{n: f"__f_{n}" for n in values}})
    pre = v.withColumnsRenamed({scenario: "present", **{n: f"__p_{n}" for n in values}})
    out = pairs.join(fut, "future").join(pre, ["present", *keys])
    return out.select("model", *keys, *[(F.col(f"__f_{n}") - F.col(f"__p_{n}")).alias(n) for n in values])


def merge_layers(left: DataFrame, right: DataFrame, keys: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """Outer merge; a missing value yields to a present one, differing values raise at run time."""
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in shared})
    out = left.join(r, list(keys), "full_outer")
    fixed = {}
    for c in shared:
        clash = F.col(c).isNotNull() & F.col(f"__r_{c}").isNotNull() & (F.col(c) != F.col(f"__r_{c}"))
        fixed[c] = F.when(clash, F.raise_error(F.lit(f"conflicting values of {c}"))).otherwise(F.coalesce(c, f"__r_{c}"))
    return out.withColumns(fixed).drop(*[f"__r_{c}" for c in shared])


def merge_many(layers: Sequence[DataFrame], keys: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """Outer merge of any number of layers, each with one row a key at most, in one exchange.

    Shared columns may be in several layers: a missing value yields to a present one, differing values raise at
    run time.  Every other column belongs to one layer.
    """
    rows = layers[0]
    for layer in layers[1:]:
        rows = rows.unionByName(layer, allowMissingColumns=True)
    own = [c for c in rows.columns if c not in (*keys, *shared)]
    both = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in (*shared, *own)], *[F.min(c).alias(f"__lo_{c}") for c in shared])
    agreed = {c: F.when(F.col(c) != F.col(f"__lo_{c}"), F.raise_error(F.lit(f"conflicting values of {c}"))).otherwise(F.col(c)) for c in shared}
    return both.withColumns(agreed).drop(*[f"__lo_{c}" for c in shared])


def fill_from(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Missing primary values take the secondary product's value."""
    s = secondary.select(*keys, *[F.nanvl(F.col(v), F.lit(None)).alias(f"__s_{v}") for v in values])
    out = primary.join(s, list(keys), "left")
    return out.withColumns({v: F.coalesce(F.nanvl(F.col(v), F.lit(None)), f"__s_{v}") for v in values}).drop(
        *[f"__s_{v}" for v in values])


def split_antimeridian(boxes: DataFrame) -> DataFrame:
    """A box with xmin > xmax becomes two boxes that meet at +-180 degrees."""
    box = lambda a, b: F.struct(a.alias("xmin"), b.alias("xmax"))
    a, b = F.col("xmin"), F.col("xmax")
    parts = F.when(a <= b, F.array(box(a, b))).otherwise(F.array(box(a, F.lit(180.0)), box(F.lit(-180.0), b)))
    rest = [c for c in boxes.columns if c not in ("xmin", "xmax")]
    return boxes.select(*rest, F.inline(parts))


def nearest_year_owner(years: DataFrame, year: str, first: int, last: int, keys: Sequence[str] = ()) -> DataFrame:
    """(target year, source year): every target in [first, last] takes the nearest source year, the earlier on ties.

    A source year owns the targets between the midpoints to its neighbours, so
    only the distinct source years are read and nothing is crossed.
    """
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(year)
    y = years.select(*keys, year).distinct().withColumns({"__p": F.lag(year).over(w), "__n": F.lead(year).over(w)})
    lo = F.coalesce(F.floor((F.col("__p") + F.col(year)) / 2) + 1, F.lit(first))
    hi = F.coalesce(F.floor((F.col("__n") + F.col(year)) / 2), F.lit(last))
    y = y.withColumns({"__lo": F.greatest(lo, F.lit(first)), "__hi": F.least(hi, F.lit(last))}).where("__lo <= __hi")
    targets = F.sequence(F.col("__lo").cast("int"), F.col("__hi").cast("int"))
    return y.select(*keys, F.explode(targets).alias("target_year"), F.col(year).alias("source_year"))


def nearest_in_axis(axis: DataFrame, value: str, index: str, at: Mapping[str, float]) -> DataFrame:
    """Index of the axis value nearest to each requested coordinate (smaller index on ties)."""
    return axis.agg(*[F.min_by(index, F.struct(F.abs(F.col(value) - F.lit(float(c))), F.col(index))).alias(n) for n, c in at.items()])


def nearest_on_axis(
    points: DataFrame, coord: str, axis: DataFrame, value: str, index: str, name: str, width: float
) -> DataFrame:
    """Index of the nearest axis value for every point, the smaller value on ties.

    Each axis value owns the half-open interval between the midpoints to its
    neighbours, cut into cells of ``width`` that act as the join key; one range
    condition picks the owner.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("__c")
    a = axis.select(F.col(value).alias("__c"), F.col(index).alias(name)).withColumns(
        {"__p": F.lag("__c").over(w), "__n": F.lead("__c").over(w)})
    first = axis.agg(F.min(value)).scalar()
    last = axis.agg(F.max(value)).scalar()
    inside = F.least(F.greatest(F.col(coord), first), last)
    a = a.withColumns({"__lo": (F.col("__p") + F.col("__c")) / 2, "__hi": (F.col("__n") + F.col("__c")) / 2})
    lo, hi = F.coalesce("__lo", "__c"), F.coalesce("__hi", "__c")
    a = a.withColumn("__k", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))).drop("__c", "__p", "__n")
    p = points.withColumns({"__x": inside}).withColumn("__k", F.floor(F.col("__x") / width))
    owned = (F.col("__lo").isNull() | (F.col("__x") > F.col("__lo"))) & (F.col("__hi").isNull() | (F.col("__x") <= F.col("__hi")))
    return p.join(a, "__k").where(owned).drop("__k", "__x", "__lo", "__hi")
