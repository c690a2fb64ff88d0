"""Exact nearest-neighbour gap filling by a separable Euclidean distance transform.

Two exchanges, whatever the size of a hole, and no join of gaps with valid cells.  Bands of rows find
the nearest valid cells of each row for every column that has gaps somewhere.  Bands of columns then
look along each column: a row whose nearest valid cell is g columns away is a parabola g^2 + dy^2, and
the lowest one at a gap names its nearest cell.  Lists of the k nearest are merged outwards until no
farther row can matter; for one neighbour, gaps that are still open after some rows take theirs from the
lower envelope of their column's parabolas, so that the width of a hole does not count.  Along a column
nothing beyond the k-th valid cell next to a gap can be among its k nearest, so such cells stay behind.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least rows of a band in the first pass and most columns of a band in the second.
BAND = 64
#: Cells of a band, where one row or column does not hold more: bands follow the shape of the grid.
CELLS = 1 << 18
#: Rows looked at on either side of a gap before the envelope takes over.
OUTWARDS = 32
FAR = np.iinfo(np.int64).max // 4


def _nearest_in_rows(valid: np.ndarray, xs: np.ndarray, r: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k nearest valid cells in the row of each cell (r, c), the left one on ties; -1 where there are fewer."""
    w = len(xs)
    at = np.arange(w)
    left = np.maximum.accumulate(np.where(valid, at, -1), axis=1)
    right = np.minimum.accumulate(np.where(valid, at, w)[:, ::-1], axis=1)[:, ::-1]
    found = np.empty((len(r), 2 * k), dtype=np.int64)
    now = left[r, c]
    for j in range(k):
        found[:, j] = now
        now = np.where(now > 0, left[r, now - 1], -1)
    now = np.where(c < w - 1, right[r, np.minimum(c + 1, w - 1)], w)
    for j in range(k, 2 * k):
        found[:, j] = np.where(now < w, now, -1)
        now = np.where(now < w - 1, right[r, np.minimum(now + 1, w - 1)], w)
    far = np.where(found >= 0, np.abs(xs[found] - xs[c][:, None]), FAR)
    return np.take_along_axis(found, np.argsort(far, axis=1, kind="stable"), axis=1)[:, :k]  # left ones come first


def _wanted(valid: np.ndarray, gap: np.ndarray, k: int) -> np.ndarray:
    """Cells with fewer than k valid ones between them and a gap, or the edge of the band, in their column."""
    out = np.zeros_like(valid)
    for v, g, o in ((valid, gap, out), (valid[::-1], gap[::-1], out[::-1])):
        count = np.cumsum(v, axis=0)
        o |= count - v - np.maximum.accumulate(np.where(g, count, 0), axis=0) < k
    return out


def _lowest(ys: np.ndarray, height: np.ndarray, at: list[np.ndarray]) -> list[np.ndarray]:
    """Per column, the row (by number) of the lowest parabola at each of the places ``at``, the first row on ties; -1 for none.

    The envelopes of all columns grow together, row by row, in whole numbers.
    """
    m, w = height.shape
    stack, start, top = np.zeros((m, w), dtype=np.int64), np.zeros((m, w), dtype=np.int64), np.full(w, -1)
    for r in range(m):
        cols = np.flatnonzero(height[r] < FAR)
        while len(cols):
            p = stack[top[cols], cols]
            since = np.where(top[cols] < 0, ys[0], (height[r, cols] - height[p, cols] + ys[r] ** 2 - ys[p] ** 2) // np.maximum(2 * (ys[r] - ys[p]), 1) + 1)
            hidden = (top[cols] >= 0) & (since <= start[top[cols], cols])
            put = cols[~hidden]
            top[put] += 1
            stack[top[put], put], start[top[put], put] = r, since[~hidden]
            cols = cols[hidden]
            top[cols] -= 1
    return [stack[np.maximum(np.searchsorted(start[:top[c] + 1, c], y, side="right") - 1, 0), c] if top[c] >= 0 else np.full(len(y), -1) for c, y in enumerate(at)]


def _merged(ys: np.ndarray, dx2: np.ndarray, sx: np.ndarray, r: np.ndarray, c: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Squared distance, row and list place of the k nearest cells of each gap (r, c), merged from its own row outwards.

    Last come the gaps still open after ``most`` rows.
    """
    k = dx2.shape[2]
    none = np.full((len(r), k), FAR)
    best, rows, place, xs = dx2[r, c], np.repeat(r[:, None], k, 1), np.repeat(np.arange(k)[None, :], len(r), 0), sx[r, c]
    best, xs = np.where(best < FAR, best, none), np.where(best < FAR, xs, 0)
    alive, step = np.arange(len(r)), 1
    while len(alive) and (most is None or step <= most):
        go_on = np.zeros(len(alive), dtype=bool)
        for side in (-step, step):
            other = r[alive] + side
            dy2 = np.where((other >= 0) & (other < len(ys)), (ys[np.clip(other, 0, len(ys) - 1)] - ys[r[alive]]) ** 2, FAR)
            near = (dy2 < FAR) & (dy2 <= best[alive, -1])
            go_on |= near
            a, o, d = alive[near], other[near], dy2[near, None]
            new = np.where(dx2[o, c[a]] < FAR, dx2[o, c[a]] + d, FAR)
            every = [np.hstack(p) for p in ((best[a], new), (rows[a], np.repeat(o[:, None], k, 1)), (place[a], np.repeat(np.arange(k)[None, :], len(o), 0)), (xs[a], sx[o, c[a]]))]
            order = np.lexsort((every[3], every[1], every[0]), axis=-1)[:, :k]
            best[a], rows[a], place[a], xs[a] = (np.take_along_axis(e, order, 1) for e in every)
        alive, step = alive[go_on], step + 1
    return best, rows, place, alive


def _lists(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat, kind))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _first_pass(table: pa.Table, values: int, keys: Sequence[str], gap_columns: list[np.ndarray], k: int, band: int) -> Iterator[pa.Table]:
    """Of one band of rows: a row for each wanted cell with the nearest valid cells of its row."""
    iy, ix = _column(table, "iy"), _column(table, "ix")
    ys, r = np.unique(iy, return_inverse=True)
    for number in range(values):
        if not len(gap_columns[number]):
            continue
        v = table.column(f"v{number}")
        known = ~np.asarray(v.is_null().combine_chunks())
        xs = np.union1d(ix, gap_columns[number])
        c = np.searchsorted(xs, ix)
        valid, gap, value = (np.zeros((len(ys), len(xs)), dtype=t) for t in (bool, bool, float))
        valid[r[known], c[known]] = True
        value[r[known], c[known]] = v.combine_chunks().filter(pa.array(known)).to_numpy()
        gap[r[~known], c[~known]] = True
        wanted = _wanted(valid, gap, k)
        wanted[:, ~np.isin(xs, gap_columns[number])] = False
        wr, wc = np.nonzero(wanted)
        near = _nearest_in_rows(valid, xs, wr, wc, k)
        keep = (near[:, 0] >= 0) | gap[wr, wc]
        wr, wc, near = wr[keep], wc[keep], near[keep]
        there = near >= 0
        n = len(wr)
        yield pa.table({**{key: pa.array([table.column(key)[0].as_py()] * n, table.schema.field(key).type) for key in keys},
                        "band": pa.array(xs[wc] // band), "value": pa.array(np.full(n, number, dtype=np.int32)), "iy": pa.array(ys[wr]), "ix": pa.array(xs[wc]),
                        "gap": pa.array(gap[wr, wc]), "sx": _lists(xs[near[there]], there.sum(axis=1), pa.int64()),
                        "sv": _lists(value[np.repeat(wr, there.sum(axis=1)), near[there]], there.sum(axis=1), pa.float64())})


def _second_pass(table: pa.Table, keys: Sequence[str], k: int) -> Iterator[pa.Table]:
    """Of one band of columns: the filled gaps, by number of the value."""
    numbers = _column(table, "value")
    for number in np.unique(numbers):
        part = table.filter(pa.array(numbers == number)).combine_chunks()
        iy, ix, gap = _column(part, "iy"), _column(part, "ix"), np.asarray(part.column("gap").combine_chunks())
        (ys, r), (xs, c) = np.unique(iy, return_inverse=True), np.unique(ix, return_inverse=True)
        sx, sv, dx2 = np.zeros((len(ys), len(xs), k), dtype=np.int64), np.zeros((len(ys), len(xs), k)), np.full((len(ys), len(xs), k), FAR)
        lists = part.column("sx").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(iy)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = lists.flatten().to_numpy()
        sx[r[row], c[row], place], sv[r[row], c[row], place] = flat, part.column("sv").combine_chunks().flatten().to_numpy()
        dx2[r[row], c[row], place] = (flat - ix[row]) ** 2
        gr, gc = r[gap], c[gap]
        d2, rows, place, left = _merged(ys, dx2, sx, gr, gc, OUTWARDS if k == 1 else None)
        if len(left):
            cols, at = np.unique(gc[left], return_inverse=True)
            order = np.argsort(at, kind="stable")
            left, edges = left[order], np.searchsorted(at[order], np.arange(len(cols) + 1))
            found = np.concatenate(_lowest(ys - ys[0], dx2[:, cols, 0], [ys[gr[left[a:b]]] - ys[0] for a, b in zip(edges, edges[1:])]))
            rows[left, 0], place[left, 0] = np.maximum(found, 0), 0
            d2[left, 0] = np.where(found >= 0, dx2[rows[left, 0], gc[left], 0] + (ys[rows[left, 0]] - ys[gr[left]]) ** 2, FAR)
        near = d2 < FAR
        known = near.any(axis=1)
        if k == 1:
            fill = sv[rows[:, 0], gc, 0]
        else:
            weight = np.where(near, 1 / np.sqrt(np.where(near, d2, 1)), 0.0)
            fill = (weight * sv[rows, gc[:, None], place]).sum(axis=1) / np.where(known, weight.sum(axis=1), 1)
        n = len(gr)
        yield pa.table({**{key: pa.array([table.column(key)[0].as_py()] * n, table.schema.field(key).type) for key in keys},
                        "value": pa.array(np.full(n, number, dtype=np.int32)), "iy": pa.array(ys[gr]), "ix": pa.array(xs[gc]), "fill": pa.array(fill, mask=~known)})


def _grouped(df: DataFrame, keys: Sequence[str], run, schema: str) -> DataFrame:
    """``run`` over each group's table, its pieces put together."""
    def whole(table: pa.Table) -> pa.Table:
        pieces = list(run(table))
        return pa.concat_tables(pieces) if pieces else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return df.groupBy(*keys).applyInArrow(lambda table: whole(table).cast(empty.schema), schema)


def _bands(height: int, width: int, k: int) -> tuple[int, int]:
    """Rows of a band in the first pass and columns of a band in the second."""
    return max(BAND, CELLS // max(width, 1)), min(BAND, max(CELLS // (height * k), 1))


def fill_gaps(field: DataFrame, value: str | Sequence[str], neighbours: int = 1, slices: Sequence[str] = (), band: int | None = None) -> DataFrame:
    """Fill missing cells from the nearest valid ones (1) or the inverse-distance mean of the k nearest.

    Gap cells are explicit rows with a NULL value; cells without a row are neither valid nor filled.  Ties
    in distance go by (iy, ix).  Several values are filled in one pass, each from its own valid cells.  A
    gap stays NULL where its slice has no valid cell; with fewer than k cells, those are taken.  A task
    holds a band of about ``CELLS`` cells, but one column and ``BAND`` rows at least; ``band`` sets the rows
    and columns of a band by hand.
    """
    values = [value] if isinstance(value, str) else list(value)
    k, sl = neighbours, list(slices)
    names = {f"__k{i}": s for i, s in enumerate(sl)}
    doubles = {v: F.nanvl(F.col(v).cast("double"), F.lit(None)) for v in values}
    cells = field.select(*[F.col(s).alias(a) for a, s in names.items()], F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"),
                         *[c.alias(f"v{n}") for n, c in enumerate(doubles.values())])
    columns = cells.groupBy("ix").agg(F.min("iy").alias("lo"), F.max("iy").alias("hi"), *[F.max(F.col(f"v{n}").isNull()).alias(f"v{n}") for n in range(len(values))]).collect()  # one row a grid column
    height = max((r.hi for r in columns), default=0) - min((r.lo for r in columns), default=0) + 1
    by_rows, by_columns = (band, band) if band else _bands(height, len(columns), k)
    gap_columns = [np.array(sorted(r.ix for r in columns if r[f"v{n}"]), dtype=np.int64) for n in range(len(values))]
    kinds = "".join(f"{a} {dict(cells.dtypes)[a]}, " for a in names)
    keys = list(names)
    lists = _grouped(cells.withColumn("__rows", F.floor(F.col("iy") / by_rows)), [*keys, "__rows"], lambda t: _first_pass(t, len(values), keys, gap_columns, k, by_columns),
                     f"{kinds}band long, value int, iy long, ix long, gap boolean, sx array<bigint>, sv array<double>")
    filled = _grouped(lists, [*keys, "band"], lambda t: _second_pass(t, keys, k), f"{kinds}value int, iy long, ix long, fill double")
    wide = filled.groupBy(*keys, "iy", "ix").agg(*[F.max(F.when(F.col("value") == n, F.col("fill"))).alias(f"__f{n}") for n in range(len(values))])
    same = F.lit(True)
    for a, s in (*names.items(), ("iy", "iy"), ("ix", "ix")):
        same = same & field[s].eqNullSafe(wide[a])
    rest = [field[c] for c in field.columns if c not in values]
    known = {v: F.nanvl(field[v].cast("double"), F.lit(None)) for v in values}
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in known.values()])
    filled = field.where(~whole).join(wide, same, "left").select(*rest, *[F.coalesce(c, f"__f{n}").alias(v) for n, (v, c) in enumerate(known.items())])
    return field.where(whole).select(*rest, *[c.alias(v) for v, c in known.items()]).union(filled)  # rows without a gap meet nothing
