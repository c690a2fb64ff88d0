"""Exact top-k by inner product: a nearest-neighbour join over Voronoi cells.

Components become whole numbers floor(256 c), scores are exact whole numbers.  Every vector goes to the
cell of its nearest pivot.  A cell's summary holds the radius of its vectors and of its queries, and the
smallest distances to its pivot.  With a query q = p + a (|a| <= R) and a vector c = o + b (|b| <= r) of
the cells of p and o, p.o - R|o| - |q| r <= q.c <= p.o + R|o| + |q| r: the lower bounds of the nearest
vectors of all cells give a score that each query of p reaches k times, and a vector whose upper bound
p.c + R|c| stays below it is not needed there; whole cells are left out by their radius first.  Queries
are dealt into groups of neighbouring cells that fit a task, a large cell into several; a vector is sent
once to each group that needs it, into one of the group's blocks by its row number, so that neither a
hot cell nor a large group is one task.  A task keeps the queries of its block and the best k of each,
and streams the vectors past them.  The best of the blocks are merged by query.

Pivots are a bounded number of vectors in hash order; any choice gives the same result, and bounds
only save work: where vectors are spread evenly, every vector is needed by every group.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, neither as
queries; shorter vectors count as followed by zeros; components beyond the long range are its ends, so
are scores; a null id is no query and comes last among equal scores; rows with equal ids are rows of
their own (a query's own row alone is left out), ordered among equal scores in some fixed way; queries
have fewer rows where there are fewer vectors; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import arrow_type, narrow, sql_type, tidy, written

SCALE = 256
TOP = 5
PIVOTS = 256
#: Bytes of the queries of a group as floating-point numbers, and the share of queries among the rows of a block.
GROUP_BYTES = 1 << 23
BLOCK_SHARE = 8
#: Vectors and queries of one product in a task.
COLUMNS, ROWS = 1024, 1024
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def product(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Exact inner products of the rows as longs (clipped above LOWEST); ``bits`` bounds those of any score."""
    if bits < 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bits < 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.array([min(max(v, LOWEST + 1), HIGHEST) for v in exact.ravel()], dtype=np.int64).reshape(exact.shape)


@dataclass
class Cells:
    """Pivots with what is known of their cells."""

    pivots: np.ndarray
    radius: np.ndarray  # of all vectors; -1 in an empty cell
    queries: np.ndarray  # how many
    reach: np.ndarray  # radius of the queries
    norm: np.ndarray  # largest norm of a query
    nearest: list[list[float]]  # smallest distances to the pivot
    top: int

    def __post_init__(self):
        self.norms = np.sqrt((self.pivots**2).sum(axis=1))
        self.slack = 1e-9 * (self.norms.max(initial=0) + self.radius.max(initial=0) + 1) ** 2
        inner = self.pivots @ self.pivots.T  # [query cell, cell]
        spread = self.reach[:, None] * self.norms[None, :]
        lower = [inner[:, i] - spread[:, i] - self.norm * near for i, nears in enumerate(self.nearest) for near in nears]
        count = self.top + 1  # a query's own row may be among them
        self.reached = np.partition(np.array(lower), -count, axis=0)[-count] if len(lower) >= count else np.full(len(self.pivots), -np.inf)
        upper = inner + spread + self.norm[:, None] * self.radius[None, :]
        self.needed = (upper + self.slack >= self.reached[:, None]) & (self.queries > 0)[:, None] & (self.radius >= 0)[None, :]

    def wanted(self, y: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Vectors x query cells: where a vector may be among the best."""
        upper = y @ self.pivots.T + np.sqrt((y**2).sum(axis=1))[:, None] * self.reach[None, :]
        return self.needed.T[cell] & (upper + self.slack >= self.reached[None, :])

    def groups(self, most: int) -> list[list[tuple[int, int, int]]]:
        """(cell, slice, slices) of each group: a chain of near cells, cut after ``most`` queries; larger cells in slices."""
        left, chain = [int(c) for c in np.flatnonzero(self.queries)], []
        while left:
            at = left[0] if not chain else min(left, key=lambda c: float(((self.pivots[c] - self.pivots[chain[-1]]) ** 2).sum()))
            chain.append(at)
            left.remove(at)
        out, size = [], 0
        for cell in chain:
            slices = -(-int(self.queries[cell]) // most)
            for s in range(slices):
                n = self.queries[cell] / slices
                if not out or size + n > most:
                    out.append([])
                    size = 0
                out[-1].append((cell, s, slices))
                size += n
        return out


def _cleaned(rows: DataFrame, id_col: str, vector_col: str, is_query: Column, scale: int) -> DataFrame:
    kept = narrow(rows.withColumn("__query", F.coalesce(is_query, F.lit(False))), vec_id=id_col, embedding=vector_col, query="__query")
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    entries = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    return kept.filter(F.col("embedding").isNotNull() & sound).select("vec_id", "query", entries.alias("y"))


def _padded(column: pa.Array, d: int) -> np.ndarray:
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == d).all():
        return flat.reshape(-1, d).astype(np.int64, copy=False)
    out = np.zeros((len(sizes), d), dtype=np.int64)
    out[np.arange(d)[None, :] < sizes[:, None]] = flat
    return out


def _binary(y: np.ndarray, kind: str) -> pa.Array:
    raw = np.ascontiguousarray(y.astype(kind))
    width = raw.shape[1] * raw.itemsize
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def _unpacked(column: pa.Array, kind: str, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, d).astype(np.int64)


def _placed(vectors: DataFrame, pivots: np.ndarray, d: int, kind: str) -> DataFrame:
    """Vectors as packed numbers with a row number, their cell and the distance to its pivot."""
    half = (pivots**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _padded(batch.column(3), d)
            f = y.astype(np.float64)
            cell = (f @ pivots.T - half).argmax(axis=1).astype(np.int32)
            near = np.sqrt(((f - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(y, kind), pa.array(cell), pa.array(near), pa.array(np.sqrt((f**2).sum(axis=1)))],
                                             ["rid", "vec_id", "query", "y", "cell", "near", "norm"])

    numbered = vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "query", "y")
    return written(numbered.mapInArrow(tidy(run), f"rid long, vec_id {sql_type(vectors, 'vec_id')}, query boolean, y binary, cell int, near double, norm double"), "cells")


def _summary(placed: DataFrame, pivots: np.ndarray, top: int) -> Cells:
    """The cells' summaries; a task gives at most one row a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(pivots)
        radius, queries, reach, norm, nearest = np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), [[] for _ in range(n)]
        for batch in batches:
            cell, near, length, query = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            np.maximum.at(radius, cell, near)
            np.add.at(queries, cell[query], 1)
            np.maximum.at(reach, cell[query], near[query])
            np.maximum.at(norm, cell[query], length[query])
            for c in np.unique(cell):
                nearest[c] = sorted([*nearest[c], *np.sort(near[cell == c])[:top + 1].tolist()])[:top + 1]
        seen = np.flatnonzero(radius >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), *[pa.array(a[seen]) for a in (radius, queries, reach, norm)], pa.array([nearest[c] for c in seen], pa.list_(pa.float64()))],
            ["cell", "radius", "queries", "reach", "norm", "nearest"])

    parts = placed.select("cell", "near", "norm", "query").mapInArrow(tidy(run), "cell int, radius double, queries long, reach double, norm double, nearest array<double>")
    rows = parts.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("queries").alias("queries"), F.max("reach").alias("reach"), F.max("norm").alias("norm"),
                                     F.slice(F.array_sort(F.flatten(F.collect_list("nearest"))), 1, top + 1).alias("nearest")).collect()
    n = len(pivots)
    cells = Cells(pivots, np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), [[] for _ in range(n)], top)
    for r in rows:
        cells.radius[r.cell], cells.queries[r.cell], cells.reach[r.cell], cells.norm[r.cell], cells.nearest[r.cell] = r.radius, r.queries, r.reach, r.norm, r.nearest
    cells.__post_init__()
    return cells


def _mixed(rid: np.ndarray) -> np.ndarray:
    """Well spread numbers for row numbers."""
    x = rid.astype(np.uint64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _routed(placed: DataFrame, cells: Cells, kind: str, d: int, total: int, group_queries: int) -> DataFrame:
    """Vectors to a block of every group that needs them, queries to all blocks of their group."""
    groups = cells.groups(group_queries)
    size = [sum(float(cells.queries[c]) / n for c, _, n in g) for g in groups]
    blocks = np.array([max(1, -(-total // max(1, round(BLOCK_SHARE * s)))) for s in size], dtype=np.int64)
    members = [np.array(sorted({c for c, _, _ in g})) for g in groups]
    place = {(c, s): k for k, g in enumerate(groups) for c, s, _ in g}
    slices = np.array([max((n for g in groups for c, _, n in g if c == cell), default=1) for cell in range(len(cells.pivots))], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(batch, rows, group, block, query):
            part = batch.take(pa.array(rows))
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(v, dtype=t), len(rows))) for v, t in ((group, np.int32), (block, np.int64))]
                                              + [pa.array(np.full(len(rows), query)), *part.columns[:2], part.column(3)], ["group", "block", "vector", "rid", "vec_id", "y"])

        for batch in batches:
            y, cell = _unpacked(batch.column(3), kind, d).astype(np.float64), batch.column(4).to_numpy(zero_copy_only=False)
            spread = _mixed(batch.column(0).to_numpy())
            wanted = cells.wanted(y, cell)
            for k, m in enumerate(members):
                rows = np.flatnonzero(wanted[:, m].any(axis=1))
                if len(rows):
                    yield sent(batch, rows, k, (spread[rows] % np.uint64(blocks[k])).astype(np.int64), True)
            mine = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            own = np.array([place[int(c), int(s)] for c, s in zip(cell[mine], (spread[mine] >> np.uint64(32)) % slices[cell[mine]].astype(np.uint64))], dtype=np.int64)
            for k in np.unique(own):
                for block in range(blocks[k]):
                    yield sent(batch, mine[own == k], k, block, False)

    return placed.select("rid", "vec_id", "query", "y", "cell").mapInArrow(
        tidy(run), f"group int, block long, vector boolean, rid long, vec_id {sql_type(placed, 'vec_id')}, y binary")


class Block:
    """The queries of a block with the best so far; earlier vectors win among equal scores."""

    def __init__(self, rids: np.ndarray, y: np.ndarray, top: int, bits: int, kind: pa.DataType):
        order = np.argsort(rids)
        self.rids, self.y, self.bits = rids[order], y[order], bits
        self.score = np.full((len(rids), top), LOWEST, dtype=np.int64)
        self.ids = np.full((len(rids), top), -1, dtype=np.int64)  # places in self.seen
        self.seen = pa.array([], kind)
        self.top = top

    def add(self, rids: np.ndarray, ids: pa.Array, y: np.ndarray) -> None:
        for k in range(0, len(rids), COLUMNS):
            own = np.searchsorted(self.rids, rids[k:k + COLUMNS])
            own = np.where(self.rids[np.minimum(own, len(self.rids) - 1)] == rids[k:k + COLUMNS], own, -1)
            for q in range(0, len(self.rids), ROWS):
                part = slice(q, q + ROWS)
                s = product(self.y[part], y[k:k + COLUMNS], self.bits)
                mine = np.flatnonzero((own >= q) & (own < q + ROWS))
                s[own[mine] - q, mine] = LOWEST
                hit = np.flatnonzero(s.max(axis=1) > self.score[part, -1])
                if len(hit):
                    every = np.hstack([self.score[part][hit], s[hit]])
                    places = np.hstack([self.ids[part][hit], np.broadcast_to(len(self.seen) + np.arange(s.shape[1]), (len(hit), s.shape[1]))])
                    best = np.argsort(~every, axis=1, kind="stable")[:, :self.top]  # ~v falls as v rises and cannot overflow
                    self.score[q + hit], self.ids[q + hit] = np.take_along_axis(every, best, 1), np.take_along_axis(places, best, 1)
            self.seen = pa.concat_arrays([self.seen, ids.slice(k, COLUMNS)])
            self._forget()

    def _forget(self) -> None:
        """Keep the ids that are among the best only."""
        if len(self.seen) > 8 * self.ids.size + 65536:
            used = np.unique(self.ids[self.ids >= 0])
            self.seen = self.seen.take(pa.array(used))
            self.ids = np.where(self.ids >= 0, np.searchsorted(used, self.ids), -1)

    def rows(self) -> pa.RecordBatch:
        row, col = np.nonzero(self.score > LOWEST)
        return pa.RecordBatch.from_arrays([pa.array(self.rids[row]), pa.array(col.astype(np.int32)), self.seen.take(pa.array(self.ids[row, col])), pa.array(self.score[row, col])],
                                          ["query", "place", "vec_id", "score"])


def _solved(routed: DataFrame, kind: str, d: int, bits: int, top: int) -> DataFrame:
    """The best of every query in each of its blocks."""
    ids = arrow_type(routed, "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, rids, ys = None, None, [], []
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)]).T if len(batch) else np.zeros((0, 3))
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)] if len(batch) else []
            for a, b in zip(edges, edges[1:]):
                part, key = batch.slice(a, b - a), tuple(keys[a, :2])
                if key != at:
                    if block is not None:
                        yield block.rows()
                    at, block, rids, ys = key, None, [], []
                y = _unpacked(part.column(5), kind, d)
                if not keys[a, 2]:
                    rids.append(part.column(3).to_numpy())
                    ys.append(y)
                    continue
                if not rids:  # a slice may have no query
                    continue
                if block is None:
                    block = Block(np.concatenate(rids), np.concatenate(ys), top, bits, ids)
                block.add(part.column(3).to_numpy(), part.column(4).cast(ids), y)
        if block is not None:
            yield block.rows()

    order = ["group", "block", "vector", F.col("vec_id").asc_nulls_last(), "rid"]
    return routed.repartition("group", "block").sortWithinPartitions(*order).mapInArrow(
        tidy(run), f"query long, place int, vec_id {sql_type(routed, 'vec_id')}, score long")


def top_scores(rows: DataFrame, is_query: Column, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
               pivots: int = PIVOTS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the best rows for each query row."""
    vectors = _cleaned(rows, id_col, vector_col, is_query, scale)
    kind = sql_type(vectors, "vec_id")
    size = vectors.agg(F.max(F.size("y")).alias("d"), F.max(F.array_max("y")).alias("high"), F.min(F.array_min("y")).alias("low"), F.count("*").alias("n")).first()
    if not size.n:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    d, largest = max(size.d, 1), max(abs(size.high or 0), abs(size.low or 0))
    packed = next((t for t, n in (("<i1", 7), ("<i2", 15), ("<i4", 31)) if largest < 1 << n), "<i8")
    chosen = vectors.select("y").orderBy(F.xxhash64("y")).limit(min(pivots, int(size.n**0.5) + 1)).collect()
    centres = np.unique(np.array([r.y + [0] * (d - len(r.y)) for r in chosen], dtype=np.float64), axis=0)
    placed = _placed(vectors, centres, d, packed)
    cells = _summary(placed, centres, top)
    routed = _routed(placed, cells, packed, d, size.n, max(1, group_bytes // (8 * d)))
    best = _solved(routed, packed, d, 2 * largest.bit_length() + d.bit_length(), top)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "place")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = placed.filter("query").select(F.col("rid").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(rows: DataFrame) -> DataFrame:
    """The registered search: rows with ids divisible by 50 against all others."""
    return top_scores(rows, F.col("vec_id") % 50 == 0)


#: The same search in DuckDB, every query row against every row.
SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS y, row_number() OVER () AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, q.rid AS query, c.vec_id, c.rid, list_inner_product(q.y, c.y)::BIGINT AS score FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, rid))::INT AS rank, vec_id, score FROM s QUALIFY rank <= {TOP}
"""
