"""Ordered scans that do not need one task per key.

A plain window over ``partitionBy(key)`` puts all rows of a key into one task.
Here every key is cut into blocks by a coarse, order-preserving column: windows
run per (key, block), and one summary row per block carries values across block
edges.  Results equal the plain window for any blocking.  Without a blocking
column (``block=None``) a checkpointed range partitioning takes its place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.model import as_col
from fieldspark.session import shared_dir

_B = "__block"


def _blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None) -> DataFrame:
    """Add the block column; without a block expression, by a range partitioning.

    Range bounds come from a sample, so that assignment is checkpointed before
    anything is counted on it: a retried task cannot see other blocks.
    """
    if block is not None:
        return df.withColumn(_B, block)
    shared_dir(df.sparkSession)
    return df.repartitionByRange(*keys, *order).withColumn(_B, F.spark_partition_id()).checkpoint()


def time_block(column: str | Column, days: int = 31) -> Column:
    """Block key for timestamps: index of a fixed span of days."""
    return F.floor(F.unix_micros(as_col(column).cast("timestamp")) / F.lit(days * 86_400_000_000))


def number_block(column: str | Column, width: float) -> Column:
    """Block key for numbers: index of a fixed-width interval."""
    return F.floor(as_col(column) / F.lit(width))


def _edges(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], shifted: Mapping[str, Column]) -> DataFrame:
    per_block = df.groupBy(*keys, _B).agg(*[c.alias(n) for n, c in aggs.items()])
    return per_block.select(*keys, _B, *[c.alias(n) for n, c in shifted.items()])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None,
    prev: Mapping[str, str | Column] | None = None,
    nxt: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """Add lag (``prev``) and lead (``nxt``) columns, ordered by ``order`` within ``keys``.

    ``block`` must be non-decreasing in ``order``.
    """
    prev, nxt = dict(prev or {}), dict(nxt or {})
    d = _blocked(df, keys, order, block)
    rank = F.struct(*[F.col(o) for o in order])
    inner = Window.partitionBy(*keys, _B).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(_B)
    extra, aggs, shifted, final = {}, {}, {}, {}
    for names, value_at_edge, fn, tag in ((prev, F.max_by, F.lag, "p"), (nxt, F.min_by, F.lead, "n")):
        if not names:
            continue
        packed = F.struct(*[as_col(c).alias(n) for n, c in names.items()])
        extra[f"__scan_{tag}"] = fn(packed).over(inner)
        aggs[f"__scan_{tag}e"] = value_at_edge(packed, rank)
        shifted[f"__scan_{tag}e"] = fn(f"__scan_{tag}e").over(across)
        for n in names:
            final[n] = F.coalesce(F.col(f"__scan_{tag}"), F.col(f"__scan_{tag}e"))[n]
    edges = _edges(d, keys, aggs, shifted)
    out = d.withColumns(extra).join(edges, [*keys, _B], "left").withColumns(final)
    return out.drop(_B, "__scan_p", "__scan_n", "__scan_pe", "__scan_ne")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None,
    sums: Mapping[str, str | Column],
    inclusive: bool = True,
) -> DataFrame:
    """Running sums along ``order`` within ``keys``; NULL terms count as 0.

    ``inclusive=False`` leaves out the current row, so the first row gets 0.
    """
    d = _blocked(df, keys, order, block).withColumns({f"__t_{n}": F.coalesce(as_col(c), F.lit(0)) for n, c in sums.items()})
    inner = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    across = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    edges = _edges(
        d, keys,
        {f"__s_{n}": F.sum(f"__t_{n}") for n in sums},
        {f"__s_{n}": F.coalesce(F.sum(f"__s_{n}").over(across), F.lit(0)) for n in sums},
    )
    d = d.withColumns({f"__r_{n}": F.coalesce(F.sum(f"__t_{n}").over(inner), F.lit(0)) for n in sums})
    d = d.join(edges, [*keys, _B], "left")
    d = d.withColumns({n: F.col(f"__r_{n}") + F.col(f"__s_{n}") for n in sums})
    return d.drop(_B, *[f"__{p}_{n}" for p in "trs" for n in sums])


def fill_both(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None,
    before: Mapping[str, Column],
    after: Mapping[str, Column],
) -> DataFrame:
    """Nearest non-NULL value at or before (``before``) and at or after (``after``) each row."""
    d = _blocked(df, keys, order, block)
    rank = F.struct(*[F.col(o) for o in order])
    up = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    over_up = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    over_down = Window.partitionBy(*keys).orderBy(_B).rowsBetween(1, Window.unboundedFollowing)
    extra, aggs, shifted, final = {}, {}, {}, {}
    for n, c in before.items():
        extra[f"__v_{n}"] = F.last(c, ignorenulls=True).over(up)
        aggs[f"__e_{n}"] = F.max_by(c, F.when(c.isNotNull(), rank))
        shifted[f"__e_{n}"] = F.last(f"__e_{n}", ignorenulls=True).over(over_up)
        final[n] = F.coalesce(f"__v_{n}", f"__e_{n}")
    for n, c in after.items():
        extra[f"__v_{n}"] = F.first(c, ignorenulls=True).over(down)
        aggs[f"__e_{n}"] = F.min_by(c, F.when(c.isNotNull(), rank))
        shifted[f"__e_{n}"] = F.first(f"__e_{n}", ignorenulls=True).over(over_down)
        final[n] = F.coalesce(f"__v_{n}", f"__e_{n}")
    edges = _edges(d, keys, aggs, shifted)
    out = d.withColumns(extra).join(edges, [*keys, _B], "left").withColumns(final)
    return out.drop(_B, *[f"__{p}_{n}" for p in "ve" for n in [*before, *after]])


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None,
    name: str,
    start: int = 0,
) -> DataFrame:
    """Consecutive index along ``order`` within ``keys`` (globally for no keys)."""
    d = _blocked(df, keys, order, block)
    inner = Window.partitionBy(*keys, _B).orderBy(*order)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    across = part.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    edges = _edges(d, keys, {"__base": F.count(F.lit(1))}, {"__base": F.coalesce(F.sum("__base").over(across), F.lit(0))})
    d = d.withColumn("__rank", F.row_number().over(inner)).join(edges, [*keys, _B], "left")
    return d.withColumn(name, (F.col("__rank") + F.col("__base") + F.lit(start - 1)).cast("bigint")).drop(_B, "__rank", "__base")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], pieces: int = 64
) -> DataFrame:
    """Linear-interpolated quantiles per key, exact, without holding a group in one task.

    Equal values are counted first.  A mergeable quantile sketch per key cuts the
    value range into about ``pieces`` even blocks; exact ranks follow from block
    counts, and only the two order statistics around each quantile are kept.
    """
    df = df.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None)))  # not a number is missing
    v = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    grid = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    shape = df.groupBy(*keys).agg(F.percentile_approx(value, grid).alias("__cuts"), F.count(value).alias("__n"))
    if keys:
        v = v.join(shape, list(keys))
    else:
        one = shape.select(F.struct("__cuts", "__n")).scalar()
        v = v.withColumns({"__cuts": one["__cuts"], "__n": one["__n"]})
    block = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    v = running(v, keys or [], [value], block, {"__hi": "__c"})
    lo = F.col("__hi") - F.col("__c")
    terms = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        left, frac = F.floor(pos), pos - F.floor(pos)
        has_left = (lo <= left) & (left < F.col("__hi"))
        has_right = (lo <= left + 1) & (left + 1 < F.col("__hi"))
        weight = F.when(has_left, 1 - frac).otherwise(0.0) + F.when(has_right, frac).otherwise(0.0)
        terms.append(F.sum(F.when(weight > 0, F.col(value) * weight)).alias(f"q{i}"))
    return v.groupBy(*keys).agg(*terms)
