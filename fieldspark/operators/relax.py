"""Laplace fill of missing cells by two-level domain decomposition.

Overlapping tiles of gap cells are solved exactly; between these sweeps a coarse correction takes out the
error that tiles cannot see.  The coarse space are bilinear hats at the corners of tiles, cut to the gap
cells; its matrix is the projection of the Laplace matrix itself, so every step reduces the error's energy,
and by a factor that does not depend on the width of a hole.  Holes that lie within one tile are solved once,
before; only the others take part in the rounds.  Tiles, projected residuals and coarse systems
(one a slice) are groups of bounded size; Spark moves cells to tiles and node values to cells by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.session import shared_dir

STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1))


class Tile:
    """Gap cells and their neighbours of one tile, with a halo of one cell."""

    def __init__(self, pdf: pd.DataFrame, tile: int, boundary: str):
        side = (tile + 2, tile + 2)
        py, px = pdf["py"].to_numpy() + 1, pdf["px"].to_numpy() + 1
        self.u, self.inside, self.gap = np.zeros(side), np.zeros(side, dtype=bool), np.zeros(side, dtype=bool)
        self.u[py, px], self.inside[py, px], self.gap[py, px] = pdf["u"].to_numpy(), True, pdf["gap"].to_numpy()
        self.iy, self.ix = np.zeros(side, dtype=np.int64), np.zeros(side, dtype=np.int64)
        self.iy[py, px], self.ix[py, px] = pdf["iy"].to_numpy(), pdf["ix"].to_numpy()
        core = np.zeros(side, dtype=bool)
        core[py, px] = pdf["core"].to_numpy()
        self.yy, self.xx = np.nonzero(core & self.gap)
        self.core, self.neumann = core & self.gap, boundary == "neumann"

    def neighbours(self):
        """For the four neighbours of the core gap cells: their places, and whether the stencil has them in its diagonal."""
        for dy, dx in STEPS:
            q = self.yy + dy, self.xx + dx
            yield q, np.where(~self.inside[q] & self.neumann, 0.0, 1.0)

    def applied(self, x: np.ndarray) -> np.ndarray:
        """Laplace matrix times a function that is zero where there is no cell, at the core gap cells."""
        out = np.zeros((len(self.yy), *x.shape[2:]))
        for q, there in self.neighbours():
            out += there.reshape(-1, *[1] * (x.ndim - 2)) * x[self.yy, self.xx] - x[q]
        return out

    def closed(self) -> np.ndarray:
        """Which core gap cells belong to holes that do not go on outside the core."""
        label = np.full(self.core.shape, np.iinfo(np.int64).max)
        label[self.yy, self.xx] = np.arange(len(self.yy))
        beyond = self.gap & ~self.core
        while True:  # the least label spreads over each hole; a cell next to a gap outside marks its hole by -1
            new = label[self.yy, self.xx]
            for dy, dx in STEPS:
                q = self.yy + dy, self.xx + dx
                new = np.minimum(new, np.where(beyond[q], -1, label[q]))
            if (new == label[self.yy, self.xx]).all():
                return new >= 0
            label[self.yy, self.xx] = new

    def solved(self) -> np.ndarray:
        """Values of the core gap cells for which the residual vanishes, all others being fixed."""
        number = np.full(self.core.shape, -1)
        number[self.yy, self.xx] = np.arange(len(self.yy))
        rows = np.arange(len(self.yy))
        a, b = np.zeros((len(rows), len(rows))), np.zeros(len(rows))
        for q, there in self.neighbours():
            a[rows, rows] += there
            own = number[q] >= 0
            a[rows[own], number[q][own]] -= 1.0
            b += np.where(own, 0.0, self.u[q])
        try:
            return np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(a, b, rcond=None)[0]


class Hats:
    """Piecewise linear functions at every ``side`` cells of an axis of n cells; the last one wraps around if periodic."""

    def __init__(self, n: int, side: int, periodic: bool):
        self.n, self.side, self.periodic, self.intervals = n, side, periodic, -(-n // side)
        self.nodes = self.intervals + (not periodic)

    def column(self, i: Column) -> tuple[Column, Column]:
        """Interval of a cell and its share of the right node."""
        left = F.floor(i / self.side)
        width = F.when(left == self.intervals - 1, self.n - (self.intervals - 1) * self.side).otherwise(self.side) if self.periodic else F.lit(self.side)
        return left, (i - left * self.side) / width

    def array(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left = i // self.side
        width = np.where(self.periodic & (left == self.intervals - 1), self.n - (self.intervals - 1) * self.side, self.side)
        return left, (left + 1) % self.nodes, (i - left * self.side) / width

    def right(self, left: Column) -> Column:
        return (left + 1) % self.nodes


def _shapes(t: Tile, y: Hats, x: Hats) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that matter in a tile, and their hats at its gap cells: (side, side, nodes)."""
    gy, gx = np.nonzero(t.gap)
    (a, b, v), (c, d, w) = y.array(t.iy[gy, gx]), x.array(t.ix[gy, gx])
    corners = [(p * x.nodes + q, s * r) for p, s in ((a, 1 - v), (b, v)) for q, r in ((c, 1 - w), (d, w))]
    nodes, at = np.unique(np.concatenate([n for n, _ in corners]), return_inverse=True)
    hats = np.zeros((*t.gap.shape, len(nodes)))
    np.add.at(hats, (np.tile(gy, 4), np.tile(gx, 4), at), np.concatenate([s for _, s in corners]))
    return nodes, hats


def _coarse_solved(matrix: pd.DataFrame, residual: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and corrections of one slice by conjugate gradients on its sparse matrix."""
    nodes, at = np.unique(np.concatenate([matrix["i"], matrix["j"]]), return_inverse=True)
    i, j, a = at[:len(matrix)], at[len(matrix):], matrix["a"].to_numpy()
    n, b = len(nodes), np.zeros(len(nodes))
    own = residual[residual["i"].isin(nodes)]  # a hat that is zero at every gap cell has no row
    b[np.searchsorted(nodes, own["i"])] = own["r"].to_numpy()
    diagonal = np.bincount(i[i == j], a[i == j], minlength=n)
    free = diagonal > 1e-12 * max(diagonal.max(initial=0), 1)
    b, scale = np.where(free, b, 0.0), np.where(free, 1 / np.where(free, diagonal, 1), 0.0)
    e, r = np.zeros(n), b.copy()
    z = scale * r
    p, rho = z.copy(), float(r @ z)
    goal, steps = 1e-20 * rho, 0
    while rho > goal and steps < 10 * n:  # n steps end it in exact arithmetic
        q = np.where(free, np.bincount(i, a * p[j], minlength=n), 0.0)
        alpha = rho / float(p @ q)
        e, r, steps = e + alpha * p, r - alpha * q, steps + 1
        z = scale * r
        p, rho = z + (float(r @ z) / rho) * p, float(r @ z)
    return nodes, e


def laplace_fill(
    field: DataFrame, value: str, ny: int, nx: int, slices: Sequence[str] = (), boundary: str = "neumann", tile: int = 48, tol: float = 1e-6,
    on_round: Callable[[int, float], None] | None = None,
) -> DataFrame:
    """Solve the Laplace equation on missing cells with the known cells as boundary, for all slices at once.

    Gap cells are explicit NULL rows of a complete grid.  Edges: ``neumann`` (clamp to self), ``dirichlet``
    (zero) or ``periodic``.  Only tiles with gaps take part.  A round corrects all slices by their coarse
    systems and solves all tiles at two offsets; it is checkpointed.  Rounds end when both the largest
    residual and the largest correction are below ``tol``, or when the residual rests because floating-point
    numbers carry no further.  Slices without any known cell stay missing.  ``on_round`` is told each round's
    number and residual.
    """
    if boundary not in ("neumann", "dirichlet", "periodic"):
        raise ValueError(f"unknown boundary {boundary!r}: neumann, dirichlet or periodic")
    spark, sl = field.sparkSession, list(slices)
    shared_dir(spark)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    f = field.select(*sl, "iy", "ix", v.alias("v"))
    known = f.where("v is not null")
    mean = known.groupBy(*sl).agg(F.avg("v").alias("m"))
    gaps = f.where("v is null").select(*sl, "iy", "ix")
    state = (gaps.join(mean, sl) if sl else gaps.withColumn("m", mean.scalar())).where("m is not null").withColumnRenamed("m", "u").checkpoint()
    if state.isEmpty():
        return field
    names = "".join(f"`{k}` {dict(field.dtypes)[k]}, " for k in sl)
    periodic = boundary == "periodic"
    hy, hx = Hats(ny, tile, periodic), Hats(nx, tile, periodic)

    # known cells next to a gap
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in STEPS])

    def known_around(now: DataFrame) -> DataFrame:
        near = now.select(*sl, "iy", "ix", F.explode(steps).alias("d")).select(*sl, (F.col("iy") + F.col("d.dy")).alias("iy"), (F.col("ix") + F.col("d.dx")).alias("ix"))
        if periodic:
            near = near.select(*sl, F.pmod("iy", F.lit(ny)).alias("iy"), F.pmod("ix", F.lit(nx)).alias("ix"))
        return known.join(near.distinct(), [*sl, "iy", "ix"], "left_semi").select(*sl, "iy", "ix", F.col("v").alias("u"), F.lit(False).alias("gap")).checkpoint()

    rim = known_around(state)
    wraps = (-1, 0, 1) if periodic else (0,)

    def tiles(now: DataFrame, shift: int) -> DataFrame:
        """Copies of each cell for the tile it is in and the tiles it borders; tiles with gaps only."""
        d = rim.unionByName(now.select(*sl, "iy", "ix", "u", F.lit(True).alias("gap")))
        for i, n, g, t, p in (("iy", ny, "gy", "ty", "py"), ("ix", nx, "gx", "tx", "px")):
            d = d.withColumn(g, F.explode(F.array(*[F.col(i) + k * n for k in wraps])))
            pos = F.col(g) + shift
            d = d.withColumn(t, F.explode(F.array_distinct(F.array(*[F.floor((pos + o) / tile) for o in (-1, 0, 1)]))))
            d = d.withColumn(p, (F.col(g) + shift - F.col(t) * tile).cast("int"))
        core = F.col("py").between(0, tile - 1) & F.col("px").between(0, tile - 1) & (F.col("gy") == F.col("iy")) & (F.col("gx") == F.col("ix"))
        d = d.withColumn("core", core)
        busy = d.where("core and gap").select(*sl, "ty", "tx").distinct()
        return d.join(busy, [*sl, "ty", "tx"], "left_semi").select(
            *sl, "ty", "tx", F.col("iy").cast("bigint"), F.col("ix").cast("bigint"), "py", "px", "u", "gap", "core")

    def per_tile(now: DataFrame, shift: int, run: Callable[[Tile], dict], schema: str) -> DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]

        def each(pdf: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame(run(Tile(pdf, tile, boundary)))
            for k in sl:
                out[k] = pdf[k].iloc[0]
            return out[[*sl, *columns]]

        return tiles(now, shift).groupBy(*sl, "ty", "tx").applyInPandas(each, names + schema)

    def projected(t: Tile) -> dict:
        nodes, hats = _shapes(t, hy, hx)
        a = hats[t.yy, t.xx].T @ t.applied(hats)
        i, j = np.nonzero(a)
        return {"i": nodes[i], "j": nodes[j], "a": a[i, j]}

    def residual(t: Tile) -> dict:
        nodes, hats = _shapes(t, hy, hx)
        r = -t.applied(t.u)
        return {"i": [*nodes, -1], "r": [*(hats[t.yy, t.xx].T @ r), np.abs(r).max()]}

    def swept(t: Tile) -> dict:
        return {"iy": t.iy[t.yy, t.xx], "ix": t.ix[t.yy, t.xx], "u": t.solved()}

    def coarse(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nodes, e = _coarse_solved(left, right)
        out = pd.DataFrame({"i": nodes, "e": e})
        for k in sl:
            out[k] = left[k].iloc[0]
        return out[[*sl, "i", "e"]]

    def within(t: Tile) -> dict:
        own = t.closed()
        t.yy, t.xx = t.yy[own], t.xx[own]
        return swept(t)

    whole = sl or ["one"]  # a constant key where there are no slices
    one = {} if sl else {"one": F.lit(0)}
    done = per_tile(state, 0, within, "iy bigint, ix bigint, u double").checkpoint()
    state = state.join(done, [*sl, "iy", "ix"], "left_anti").select(*sl, "iy", "ix", "u").checkpoint()
    rest = [c for c in field.columns if c != value]

    def filled(solution: DataFrame) -> DataFrame:
        return field.join(solution, [*sl, "iy", "ix"], "left").select(*rest, F.coalesce(v, "u").alias(value))

    if state.isEmpty():
        return filled(done)
    rim = known_around(state)
    matrix = per_tile(state, 0, projected, "i bigint, j bigint, a double").groupBy(*sl, "i", "j").agg(F.sum("a").alias("a")).checkpoint()
    best, stalled, number = float("inf"), 0, 0
    while True:
        parts = per_tile(state, 0, residual, "i bigint, r double").groupBy(*sl, "i").agg(
            F.when(F.col("i") < 0, F.max("r")).otherwise(F.sum("r")).alias("r")).checkpoint()
        worst = parts.where("i < 0").agg(F.max("r")).first()[0]
        number += 1
        if on_round:
            on_round(number, worst)
        rhs = parts.where("i >= 0")
        e = matrix.withColumns(one).groupBy(*whole).cogroup(rhs.withColumns(one).groupBy(*whole)).applyInPandas(coarse, f"{names}i bigint, e double").checkpoint()
        smooth = e.agg(F.max(F.abs("e"))).first()[0] or 0.0
        stalled = 0 if worst < 0.9 * best else stalled + 1
        best = min(best, worst)
        if max(worst, smooth) <= tol or stalled >= 3:
            break
        state = per_tile(per_tile(_corrected(state, e, sl, hy, hx), 0, swept, "iy bigint, ix bigint, u double"), tile // 2, swept,
                         "iy bigint, ix bigint, u double").checkpoint()
    return filled(state.select(*sl, "iy", "ix", "u").unionByName(done.select(*sl, "iy", "ix", "u")))


def _corrected(state: DataFrame, e: DataFrame, sl: Sequence[str], y: Hats, x: Hats) -> DataFrame:
    """Gap cells with the node values interpolated onto them: every patch between nodes carries its four."""
    node = e.select(*sl, F.floor(F.col("i") / x.nodes).alias("a"), (F.col("i") % x.nodes).alias("b"), "e")
    before = lambda c, h: F.pmod(F.col(c) - 1, F.lit(h.nodes)) if h.periodic else F.col(c) - 1
    corner = lambda n, a, b: F.struct(F.lit(n).alias("n"), a.alias("jy"), b.alias("jx"))
    a, b = F.col("a"), F.col("b")
    patch = node.select(*sl, "e", F.inline(F.array(corner(0, a, b), corner(1, a, before("b", x)), corner(2, before("a", y), b), corner(3, before("a", y), before("b", x)))))
    patch = patch.groupBy(*sl, "jy", "jx").agg(*[F.coalesce(F.sum(F.when(F.col("n") == k, F.col("e"))), F.lit(0.0)).alias(f"e{k}") for k in range(4)])
    (jy, wy), (jx, wx) = y.column(F.col("iy")), x.column(F.col("ix"))
    cells = state.select(*sl, "iy", "ix", "u", jy.alias("jy"), jx.alias("jx"), wy.alias("wy"), wx.alias("wx"))
    up = (1 - F.col("wx")) * F.col("e0") + F.col("wx") * F.col("e1")
    down = (1 - F.col("wx")) * F.col("e2") + F.col("wx") * F.col("e3")
    change = F.coalesce((1 - F.col("wy")) * up + F.col("wy") * down, F.lit(0.0))
    return cells.join(patch, [*sl, "jy", "jx"], "left").select(*sl, "iy", "ix", (F.col("u") + change).alias("u"))
