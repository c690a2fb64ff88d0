"""Ensemble scoring: block bootstrap, likelihoods, weights, resampling, correlation length."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldspark.functions.hashing import hashed_uniform
from fieldspark.operators import align, scan
from fieldspark.session import shared_dir


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def squared_error_blocks(
    df: DataFrame, block: int, member: str = "exp_id", sim: str = "sim", obs: str = "obs", shape: tuple[Column, Column] | None = None,
    members: Column | None = None,
) -> DataFrame:
    """Sum of squared errors and count of valid cells per member and block.

    A cell counts only when it is finite for all members.  Partial blocks at
    the far edges are trimmed; a block larger than the domain is clamped to it.
    ``shape`` is (ny, nx) and ``members`` the ensemble size; what the caller
    does not know is read from the data in one extra pass.
    """
    if shape is None or members is None:
        found = df.agg(F.struct(F.max("iy") + 1, F.max("ix") + 1, F.count_distinct(member))).scalar()
        shape = shape or (found["col1"], found["col2"])
        members = found["col3"] if members is None else members
    ny, nx = shape
    side_y, side_x = F.least(F.lit(block), ny), F.least(F.lit(block), nx)
    err = _finite(F.col(sim).cast("double")) - _finite(F.col(obs).cast("double"))
    by, bx = F.floor(F.col("iy") / side_y).alias("by"), F.floor(F.col("ix") / side_x).alias("bx")
    inside = ((by + 1) * side_y <= ny) & ((bx + 1) * side_x <= nx)
    cells = df.where(inside).select("iy", "ix", F.struct(F.col(member).alias("member"), err.alias("e")).alias("x")).groupBy("iy", "ix").agg(
        F.collect_list("x").alias("x"), F.count("x.e").alias("n"))  # one row a cell, with the errors of its members
    each = cells.where(F.col("n") == members).select(by, bx, F.inline("x")).where("e is not null")
    return each.groupBy(F.col("member").alias(member), "by", "bx").agg(F.sum(F.col("e") * F.col("e")).alias("s"), F.count(F.lit(1)).alias("c"))


#: Blocks of a chunk, and draws that a task counts at a time.
CHUNK, DRAWS = 1024, 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 32-bit numbers for 32-bit numbers (held as unsigned longs)."""
    low = np.uint64(0xFFFFFFFF)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor) & low
    return x ^ (x >> np.uint64(16))


def draw_indices(seed: int, boot: np.ndarray, node: int, draws: np.ndarray, size: int) -> np.ndarray:
    """Numbers below ``size`` of the draws of a node of the tree: 0 is the root, k + 1 chunk k."""
    as_uint = lambda v: np.asarray(v).astype(np.uint64)
    low = np.uint64(0xFFFFFFFF)
    start = _mixed((_mixed((as_uint(boot) + np.uint64(seed % 2**32)) & low) + np.uint64(node)) & low)
    return (_mixed(start ^ _mixed(as_uint(draws))) * np.uint64(size)) >> np.uint64(32)


def _chunk_draws(spark, n: int, n_boot: int, seed: int, chunk: int) -> DataFrame:
    """How many of the n draws of each resample fall into each chunk: one row for each, counted before the exchange."""
    boots = spark.range(n_boot).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // DRAWS)))).repartition("id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for boot, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                draws = np.arange(part * DRAWS, min(n, (part + 1) * DRAWS))
                m = np.bincount((draw_indices(seed, boot, 0, draws, n) // np.uint64(chunk)).astype(np.int64))
                there = np.flatnonzero(m)
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(np.full(len(there), boot, dtype=np.int32)), pa.array(m[there])], ["chunk", "boot", "m"])

    return boots.mapInArrow(run, "chunk long, boot int, m long").groupBy("chunk", "boot").agg(F.sum("m").alias("m"))


def _chunk_sums(n: int, n_boot: int, seed: int, chunk: int, kind: pa.DataType):
    """Of one chunk: (resamples x blocks) draw counts times (blocks x members) sums."""
    names = ["member", "boot", "s", "c"]

    def run(blocks: pa.Table, draws: pa.Table) -> pa.Table:
        if not blocks.num_rows or not draws.num_rows:
            return pa.table([pa.array([], t) for t in (kind, pa.int32(), pa.float64(), pa.float64())], names)
        number = blocks.column("chunk")[0].as_py()
        size = min(chunk, n - number * chunk)
        boots, m = draws.column("boot").to_numpy(), draws.column("m").to_numpy()
        counts = np.zeros((n_boot, size))
        for boot, k in zip(boots, m):
            counts[boot] = np.bincount(draw_indices(seed, boot, number + 1, np.arange(k), size).astype(np.int64), minlength=size)
        members = blocks.column("member").combine_chunks().dictionary_encode()
        at, who = blocks.column("at").to_numpy(), members.indices.to_numpy()
        out = []
        for name in ("s", "c"):
            sums = np.zeros((size, len(members.dictionary)))
            sums[at, who] = blocks.column(name).to_numpy()
            out.append(pa.array((counts @ sums).ravel()))
        who = pa.array(np.tile(np.arange(len(members.dictionary)), n_boot))
        return pa.table([members.dictionary.take(who), pa.array(np.repeat(np.arange(n_boot, dtype=np.int32), len(members.dictionary))), *out], names)

    return run


def bootstrap_rmse(blocks: DataFrame, n_boot: int = 500, seed: int = 0, member: str = "exp_id", chunk: int = CHUNK) -> DataFrame:
    """RMSE per member and resample of the non-empty blocks, the same draw for all members.

    Every resample draws as many blocks as there are, down a seeded tree: the draws of a resample are first
    counted by chunks of blocks, and those of a chunk spread over its blocks in the task that holds the
    chunk's sums, as a product of matrices.  Only (resample, chunk) counts and (resample, member) sums are
    exchanged.  The block sums are checkpointed: the fields behind them are read once.
    """
    spark = blocks.sparkSession
    shared_dir(spark)
    blocks = blocks.checkpoint()
    b = blocks.groupBy("by", "bx").agg(F.max("c").alias("c")).where(F.col("c") > 0)
    b = scan.dense_index(b, [], ["by", "bx"], F.col("by"), "k").select("by", "bx", "k").checkpoint()
    n = b.count()
    sums = blocks.join(b, ["by", "bx"]).select(
        F.floor(F.col("k") / chunk).alias("chunk"), (F.col("k") % chunk).alias("at"), F.col(member).alias("member"), "s", F.col("c").cast("double").alias("c"))
    type_ = dict(blocks.dtypes)[member]
    parts = sums.groupBy("chunk").cogroup(_chunk_draws(spark, max(n, 1), n_boot, seed, chunk).groupBy("chunk")).applyInArrow(
        _chunk_sums(n, n_boot, seed, chunk, to_arrow_type(sums.schema["member"].dataType)), f"member {type_}, boot int, s double, c double")
    out = parts.groupBy(F.col("member").alias(member), "boot").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    return out.select(member, "boot", F.sqrt(F.col("s") / F.greatest("c", F.lit(1))).alias("rmse"))


def rank_members(rmse: DataFrame, member: str = "exp_id", keys: Sequence[str] = ()) -> DataFrame:
    """Mean RMSE with 5-95 % range per member, and whether it ties with the best one.

    The quantiles run over the resamples of one member, whose number is the
    fixed ``n_boot``.
    """
    r = rmse.groupBy(*keys, member).agg(
        F.avg("rmse").alias("rmse_mean"), F.percentile("rmse", F.array(F.lit(0.05), F.lit(0.95))).alias("__q"))
    shared_dir(rmse.sparkSession)
    r = r.withColumns({"rmse_lo": F.col("__q")[0], "rmse_hi": F.col("__q")[1]}).drop("__q").checkpoint()  # one row per member
    best = r.groupBy(*keys).agg(F.min_by(F.struct(member, "rmse_hi"), F.struct("rmse_mean", member)).alias("b"))
    if keys:
        r = r.join(best.select(*keys, "b.rmse_hi").withColumnRenamed("rmse_hi", "__hi"), list(keys))
    else:
        r = r.withColumn("__hi", best.select("b.rmse_hi").scalar())
    return r.withColumn("tied_with_best", F.col("rmse_lo") <= F.col("__hi")).drop("__hi")


def ensemble_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], skipna: bool = True) -> DataFrame:
    """Linear quantiles over the member dimension, one array per key.

    One key holds one value per member.  ``skipna=False`` gives NULL when a
    member is missing.  Use :func:`scan.exact_quantiles` for whole fields.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    q = F.percentile(v, F.array(*[F.lit(float(p)) for p in probs]))
    if not skipna:
        q = F.when(F.count_if(v.isNull()) == 0, q)
    return df.groupBy(*keys).agg(q.alias("q"))


# -------------------------------------------------------------- likelihoods


def log_normal(x: Column, mu: Column, std: Column, fudge: float = 1.0) -> Column:
    """Log density; not a number, and so left out of means, where the spread is zero."""
    s = std * fudge
    r = F.try_divide(x - mu, s)
    return F.when(s == 0, F.lit(float("nan"))).otherwise(-0.5 * r * r - 0.5 * F.log(2 * math.pi * s * s))


def log_pseudo_huber(x: Column, mu: Column, std: Column, fudge: float = 1.0, delta: float = 2.0) -> Column:
    """Log density up to a constant; minus infinity where the spread is zero and there is a misfit, not a number without one."""
    r = F.try_divide(x - mu, std * fudge) / delta
    off = F.when(x != mu, F.lit(float("-inf"))).when(x == mu, F.lit(float("nan")))
    return F.when(std == 0, off).otherwise(-(delta**2) * (F.sqrt(1 + r * r) - 1) - 1)


def mean_log_likelihood(df: DataFrame, keys: Sequence[str], terms: Column, name: str = "log_likelihood") -> DataFrame:
    """Mean over the summed dimensions; terms that are exactly 0 are missing."""
    t = F.nanvl(terms, F.lit(None))
    return df.groupBy(*keys).agg(F.avg(F.when(t != 0, t)).alias(name))


def log_jaccard(df: DataFrame, keys: Sequence[str], x: str, mu: str, fudge: float = 1.0) -> DataFrame:
    """-fudge * |both > 0| / |either > 0| over cells where both are finite; 0 without overlap."""
    a, b = _finite(F.col(x).cast("double")), _finite(F.col(mu).cast("double"))
    both, either = F.count_if((a > 0) & (b > 0)), F.count_if(a.isNotNull() & b.isNotNull() & ((a > 0) | (b > 0)))
    return df.groupBy(*keys).agg((-fudge * F.coalesce(F.try_divide(both, either), F.lit(0.0))).alias("log_likelihood"))


def normalised_weights(df: DataFrame, value: str = "log_likelihood", keys: Sequence[str] = (), name: str = "weight") -> DataFrame:
    """exp(ll - max) / sum over the members of each key, by two small aggregates.

    The scores (one row per member and key) are checkpointed, so the data
    behind them is reduced once.
    """
    shared_dir(df.sparkSession)
    df = df.checkpoint()
    top = df.groupBy(*keys).agg(F.max(value).alias("__m"))
    d = df.join(top, list(keys)) if keys else df.withColumn("__m", top.scalar())
    d = d.withColumn("__w", F.exp(F.col(value) - F.col("__m")))
    tot = d.groupBy(*keys).agg(F.sum("__w").alias("__t"))
    d = d.join(tot, list(keys)) if keys else d.withColumn("__t", tot.scalar())
    return d.withColumn(name, F.try_divide(F.col("__w"), F.col("__t"))).drop("__m", "__w", "__t")


def resample(
    df: DataFrame, member: str, weight: str, n_samples: int, seed: int = 0, keys: Sequence[str] = (), bins: int = 1024, member_block: float = 4096.0,
) -> DataFrame:
    """``n_samples`` members drawn by weight with replacement per key: ``(keys, draw, member)``.

    Weights that are missing, negative or do not sum to 1 become uniform.
    Draws meet the running weight intervals through bins of the unit interval.
    The member table is checkpointed, so the data behind the weights is read once.
    """
    ks = list(keys)
    shared_dir(df.sparkSession)
    df = df.select(*ks, member, weight).checkpoint()
    w = F.col(weight)
    ok = df.groupBy(*ks).agg(
        (F.coalesce(F.abs(F.sum(w) - 1) < 1e-6, F.lit(False)) & (F.count_if(w.isNull() | F.isnan(w) | (w < 0)) == 0)).alias("__ok"),
        F.count(F.lit(1)).alias("__m"))
    if ks:
        d = df.join(ok, ks)
    else:
        d = df.withColumns({"__ok": ok.select("__ok").scalar(), "__m": ok.select("__m").scalar()})
    d = d.withColumn("__w", F.when(F.col("__ok"), w).otherwise(F.try_divide(F.lit(1.0), F.col("__m")))).drop("__ok", "__m")
    numeric = dict(df.dtypes)[member] in ("int", "bigint", "double", "float", "smallint")
    block = scan.number_block(member, member_block) if numeric else None
    d = scan.running(d, ks, [member], block, {"__hi": "__w"})
    d = d.withColumn("__lo", F.col("__hi") - F.col("__w")).where(F.col("__w") > 0)
    last = d.groupBy(*ks).agg(F.max(member).alias("__last"))
    d = d.join(last, ks) if ks else d.withColumn("__last", last.scalar())
    d = d.withColumn("__top", F.when(F.col(member) == F.col("__last"), F.lit(1.0)).otherwise(F.col("__hi")))
    span = F.sequence(F.floor(F.col("__lo") * bins), F.least(F.floor(F.col("__top") * bins), F.lit(bins - 1)))
    d = d.select(*ks, member, "__lo", "__top", F.explode(span).alias("__bin"))
    groups = df.select(*ks).distinct() if ks else df.sparkSession.range(1).select()
    u = hashed_uniform(F.lit(seed), *[F.col(k) for k in ks], F.col("draw"))
    draws = groups.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))).withColumn("__u", u)
    draws = draws.withColumn("__bin", F.floor(F.col("__u") * bins))
    return draws.join(d, [*ks, "__bin"]).where((F.col("__lo") <= F.col("__u")) & (F.col("__u") < F.col("__top"))).select(*ks, "draw", member)


def importance_sampling(
    simulated: DataFrame, observed: DataFrame, member: str, time: str, block: Column, keys: Sequence[str] = (),
    likelihood: Callable[..., Column] = log_normal, fudge: float = 3.0, n_samples: int = 100, seed: int = 0, interpolate: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Score members against observations and resample them: (scores with weights, draws).

    ``simulated`` has ``member, keys, time, sim``; ``observed`` has ``keys, time,
    obs, std``.  ``likelihood`` is any Column function of (x, mu, std, fudge).
    """
    if interpolate:
        members = simulated.select(member, *keys).distinct()
        targets = observed.join(members, list(keys)) if keys else observed.withColumn(
            member, F.explode(members.agg(F.collect_list(member)).scalar()))
        joined = align.interpolate_onto(simulated, targets, [member, *keys], time, ["sim"], block)
    else:
        joined = simulated.join(observed, [*keys, time])
    scores = mean_log_likelihood(joined, [member, *keys], likelihood(F.col("sim"), F.col("obs"), F.col("std"), fudge))
    scores = normalised_weights(scores, keys=keys)
    return scores, resample(scores, member, "weight", n_samples, seed, keys)


# -------------------------------------------------------- correlation length


#: Rows of a band in the first pass of the transform, and columns of a band in the second.
FOURIER_BAND = 64
#: Lags along y that are turned back at a time.
LAG_ROWS = 256


def _row_spectra(nx: int, band: int, keys: Sequence[str]):
    """Of a band of rows: their transforms along x, cut into bands of columns, as blocks of complex numbers."""

    def run(table: pa.Table) -> pa.Table:
        y, x = table.column("iy").to_numpy(), table.column("ix").to_numpy()
        ys, r = np.unique(y, return_inverse=True)
        rows = np.zeros((len(ys), nx))
        np.add.at(rows, (r, x), table.column("a").to_numpy())
        spectra = np.fft.rfft(rows, axis=1)
        cuts = range(0, spectra.shape[1], band)
        return pa.table({**{k: pa.array([table.column(k)[0].as_py()] * len(cuts), table.schema.field(k).type) for k in keys},
                         "kx": pa.array([c // band for c in cuts], pa.int64()), "rows": pa.array([ys.tolist()] * len(cuts), pa.list_(pa.int64())),
                         "block": pa.array([np.ascontiguousarray(spectra[:, c:c + band]).tobytes() for c in cuts])})

    return run


def _column_radials(ny: int, nx: int, band: int, keys: Sequence[str]):
    """Of a band of columns: their share of the autocovariance sums by whole radius."""
    rmax = min(ny // 2, nx // 2)
    lags = lambda n: np.arange(max(-(n // 2), -rmax), min(n - n // 2, rmax + 1))

    def run(table: pa.Table) -> pa.Table:
        first = table.column("kx")[0].as_py() * band
        width = min(band, nx // 2 + 1 - first)
        spectra = np.zeros((ny, width), dtype=np.complex128)
        for rows, block in zip(table.column("rows").to_pylist(), table.column("block").to_pylist()):
            spectra[rows] = np.frombuffer(block, dtype=np.complex128).reshape(len(rows), width)
        covariance = np.fft.ifft(np.abs(np.fft.fft(spectra, axis=0)) ** 2, axis=0)
        kx, dy, dx = first + np.arange(width), lags(ny), lags(nx)
        twice = np.where((kx == 0) | (2 * kx == nx), 1.0, 2.0)  # columns that stand for their mirror image too
        angle = (np.outer(kx, dx) % nx) * (2 * math.pi / nx)
        back = np.exp(1j * angle) * twice[:, None] / nx
        out = np.zeros(rmax + 1)
        for k in range(0, len(dy), LAG_ROWS):
            part = dy[k:k + LAG_ROWS]
            acf = covariance[part].real @ back.real - covariance[part].imag @ back.imag
            radius = np.hypot(part[:, None], dx[None, :]).astype(np.int64)
            near = radius <= rmax
            out += np.bincount(radius[near], acf[near], minlength=rmax + 1)
        return pa.table({**{k: pa.array([table.column(k)[0].as_py()] * (rmax + 1), table.schema.field(k).type) for k in keys},
                         "r": pa.array(np.arange(rmax + 1, dtype=np.int32)), "s": pa.array(out)})

    return run


def _lag_counts(ny: int, nx: int) -> list[int]:
    """Lags of each whole radius, up to half the shorter side."""
    rmax = min(ny // 2, nx // 2)
    out = np.zeros(rmax + 1, dtype=np.int64)
    dx = np.arange(-(nx // 2), nx - nx // 2)
    for dy in range(max(-(ny // 2), -rmax), min(ny - ny // 2, rmax + 1)):
        r = np.hypot(dy, dx).astype(np.int64)
        out += np.bincount(r[r <= rmax], minlength=rmax + 1)
    return out.tolist()


def decorrelation_length(
    df: DataFrame, value: str, ny: int, nx: int, keys: Sequence[str], pixel: float = 1.0, threshold: float = math.exp(-1), band: int = FOURIER_BAND,
) -> DataFrame:
    """Lag at which the radially averaged circular autocorrelation falls below ``threshold``, per field.

    Missing cells count as the field's mean; cells beyond the grid wrap around.  The autocovariance comes from
    a Fourier transform in two passes: bands of rows, one exchange that transposes their blocks, bands of
    columns, which turn their power back along y and add their share of every lag to the sums by radius.  So
    all radii are exact at once, and a task holds a band of rows or columns only.
    """
    ks, rmax = list(keys), min(ny // 2, nx // 2)
    v = _finite(F.col(value).cast("double"))
    mean = df.groupBy(*ks).agg(F.avg(v).alias("__m"), F.count(v).alias("__n"))
    a = df.where(v.isNotNull()).join(mean.select(*ks, "__m"), ks).select(
        *ks, F.pmod(F.col("iy").cast("long"), F.lit(ny)).alias("iy"), F.pmod(F.col("ix").cast("long"), F.lit(nx)).alias("ix"), (v - F.col("__m")).alias("a"))
    names = "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in ks)
    blocks = a.withColumn("__rows", F.floor(F.col("iy") / band)).groupBy(*ks, "__rows").applyInArrow(
        _row_spectra(nx, band, ks), f"{names}kx long, rows array<bigint>, block binary")
    sums = blocks.groupBy(*ks, "kx").applyInArrow(_column_radials(ny, nx, band, ks), f"{names}r int, s double").groupBy(*ks, "r").agg(F.sum("s").alias("s"))
    n = df.sparkSession.createDataFrame([(r, float(max(c, 1))) for r, c in enumerate(_lag_counts(ny, nx))], "r int, n double")
    radial = sums.join(n, "r").select(*ks, "r", (F.col("s") / F.col("n")).alias("c"))
    first = radial.groupBy(*ks).agg(F.sum(F.when(F.col("r") == 0, F.col("c"))).alias("v0"), F.sort_array(F.collect_list(F.struct("r", "c"))).alias("x"))  # rmax values
    below = F.filter("x", lambda e: e["c"] < threshold * F.col("v0"))
    lag = F.when(F.col("v0") > 0, F.try_element_at(below, F.lit(1))["r"])
    return mean.join(first.select(*ks, lag.alias("lag")), ks, "left").select(
        *ks, F.when(F.col("__n") > 0, F.coalesce("lag", F.lit(rmax)) * float(pixel)).alias("length"))


# ------------------------------------------------------------------ reports


def draw_counts(draws: DataFrame, member: str, keys: Sequence[str] = ()) -> DataFrame:
    """How often each member was drawn, and whether it is the most drawn one."""
    n = draws.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(*keys).agg(F.max_by(member, F.struct(F.col("n"), -F.col(member))).alias("__top"))
    n = n.join(top, list(keys)) if keys else n.withColumn("__top", top.scalar())
    return n.withColumn("most_drawn", F.col(member) == F.col("__top")).drop("__top")


def weighted_misfit(df: DataFrame, member: str, weight: str, residual: str) -> DataFrame:
    """sqrt(sum(w r^2) / sum(w)) per member, missing residuals left out."""
    r = F.nanvl(F.col(residual), F.lit(None))
    w = F.when(r.isNotNull(), F.col(weight))
    return df.groupBy(member).agg(F.sqrt(F.try_divide(F.sum(w * r * r), F.sum(w))).alias("misfit"))


def last_iteration_norm(df: DataFrame, member: str, cost: str, iteration: str) -> DataFrame:
    """Square root of the cost at each member's last iteration."""
    return df.groupBy(member).agg(F.sqrt(F.max_by(cost, iteration)).alias("norm"))


def join_parameters(scores: DataFrame, members: DataFrame, config: str, names: Sequence[str], member: str = "exp_id") -> DataFrame:
    """Left-join parameters parsed from each member's JSON text; keys may contain dots."""
    cols = [F.get_json_object(config, f"$['{n}']").cast("double").alias(n) for n in names]
    return scores.join(members.select(member, *cols), member, "left")
