"""Whitening of embeddings by exact integer scatter and its exact characteristic polynomial.

Entries become whole numbers x = floor(64 c) + 1000000; the offset changes no covariance and is left
out of the sums.  The fit list is every distinct vector once, found by one exchange that drops copies
before it.  Its scatter n * sum(x x') - S S' is summed exactly (limbs of 18 bits in floating-point
products below 2^53, limbs of 40 bits between tasks), whatever its size.  The polynomial is then
computed modulo primes and the eigenvectors by inverse iteration, in tasks by prime and by root
(:mod:`fieldspark.llm.charpoly`); only the matrix, whose size depends on the dimensions alone, and
the roots meet on the driver.  The components are applied to all rows in one pass.

Defined cases: vectors that are null, or hold null or non-finite entries, take no part, nor do vectors
of another length than most distinct vectors have (of equally common lengths, the greatest); entries
beyond the long range are its ends; a direction without variance has no component, so that equal
vectors, a single one, empty vectors or empty tables give no rows; a deviation beyond the long range is
null; equal eigenvalues have some orthonormal basis of their space; repeated rows stay; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import charpoly
from fieldspark.llm.common import arrow_type, narrow, sql_type, tidy, written

SCALE = 64
COMPONENTS = 16
#: Bits of a limb within a task, and between tasks.
LIMB, SUM_LIMB = 18, 40
#: Rows of one floating-point product: rows * 2^(2 * LIMB) stays below 2^53.
ROWS = 1 << 16
#: Roots are known to 2^-ROOT_BITS of their size at least.
ROOT_BITS = 200


@dataclass
class Whitening:
    """n vectors with sums S (without the offset); columns of ``directions`` are unit eigenvectors for ``values``."""

    n: int
    sums: list[int]
    trace: Fraction
    values: list[Fraction]
    directions: np.ndarray
    identity_error: float = 0.0

    @property
    def projection(self) -> np.ndarray:
        return self.directions / np.sqrt([float(v) for v in self.values])

    def whitened(self, y: np.ndarray) -> np.ndarray:
        centre = np.array([float(Fraction(s, self.n)) for s in self.sums])
        return (y - centre) @ self.projection


def _entries(c: Column, scale: int) -> Column:
    return F.transform(c, lambda v: F.floor(v.cast("double") * scale))


def _cleaned(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    rows = narrow(rows, vec_id=id_col, embedding=vector_col)
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    return rows.filter(F.col("embedding").isNotNull() & sound).select("vec_id", _entries(F.col("embedding"), scale).alias("y"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of LIMB bits, lowest first, as floats."""
    out = []
    while True:
        if y.size == 0 or (y.max() < 1 << LIMB - 1 and y.min() >= -(1 << LIMB - 1)):
            return [*out, y.astype(np.float64)]
        out.append((y & (1 << LIMB) - 1).astype(np.float64))
        y = y >> LIMB


def _products(y: np.ndarray) -> np.ndarray:
    """Exact y' y with Python's whole numbers."""
    total = 0
    for k in range(0, len(y), ROWS):
        limbs = _limbs(y[k:k + ROWS])
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def _sums(fit: DataFrame, d: int) -> list[list[int]]:
    """Exact sums of products of (y, 1): the last row holds the sums and the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), dtype=object)
        for batch in batches:
            y = _matrix(batch.column(0), d)
            if len(y):
                total = total + _products(np.hstack([y, np.ones((len(y), 1), dtype=np.int64)]))
        rows = []
        for i in range(d + 1):
            for j in range(i + 1):
                v, limb = int(total[i, j]), 0
                while v not in (0, -1):
                    rows.append((i, j, limb, v & (1 << SUM_LIMB) - 1))
                    v, limb = v >> SUM_LIMB, limb + 1
                if v:
                    rows.append((i, j, limb, -1))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], ["i", "j", "limb", "v"])

    sums = fit.select("y").mapInArrow(tidy(run), "i long, j long, limb long, v long").groupBy("i", "j", "limb").agg(F.sum("v").alias("v")).collect()
    out = [[0] * (d + 1) for _ in range(d + 1)]
    for i, j, limb, v in sums:
        out[i][j] += v << SUM_LIMB * limb
    return [[out[max(i, j)][min(i, j)] for j in range(d + 1)] for i in range(d + 1)]


def _polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Characteristic polynomial, with the primes dealt over tasks."""
    d = len(matrix)
    ps = charpoly.primes_beyond(charpoly.coefficient_bound(d, sum(matrix[i][i] for i in range(d))))

    def run(batches):
        for batch in batches:
            mine = batch.column(0).to_pylist()
            for k in range(0, len(mine), 16):
                part = mine[k:k + 16]
                found = charpoly.modular_polynomials(matrix, part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))], ["p", "f"])

    table = spark.createDataFrame([(p,) for p in ps], "p long").repartition(min(len(ps), 2 * spark.sparkContext.defaultParallelism))
    found = table.mapInArrow(tidy(run), "p long, f array<long>").collect()
    return charpoly.remaindered([r.f for r in found], [r.p for r in found])


def _vectors(spark, matrix: list[list[int]], roots: list[charpoly.Root]) -> list[list[list[float]]]:
    """Orthonormal eigenvectors of each root, one task each."""
    values = [(r.value, r.multiplicity, int(r.lo.bit_length() * 0.302) + 40) for r in roots]

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([charpoly.null_vectors(matrix, *values[k])], pa.list_(pa.list_(pa.float64())))], ["k", "v"])

    table = spark.range(len(roots)).repartition(max(1, len(roots)), "id")
    return [r.v for r in sorted(table.mapInArrow(tidy(run), "k long, v array<array<double>>").collect())]


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, int]:
    """The components of the distinct vectors ``y`` and their length; none where nothing varies."""
    spark = vectors.sparkSession
    fit = written(vectors.select("y").distinct(), "fit")
    lengths = fit.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    if not d:
        return None, d
    fit = fit.filter(F.size("y") == d)
    sums = _sums(fit, d)
    n, s = sums[d][d], sums[d][:d]
    scatter = [[n * sums[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    if not trace:
        return None, d
    roots, wanted = charpoly.largest_roots(_polynomial(spark, scatter), components, ROOT_BITS), []
    for r in roots:
        if sum(w.multiplicity for w in wanted) < components:
            wanted.append(r)
    pairs = [(r.value, v) for r, vs in zip(wanted, _vectors(spark, scatter, wanted)) for v in vs][:components]
    model = Whitening(n, s, Fraction(trace, n * n), [v / (n * n) for v, _ in pairs], np.array([v for _, v in pairs]).T)
    model.identity_error = _identity_error(fit, model, d)
    return model, d


def _identity_error(fit: DataFrame, model: Whitening, d: int) -> float:
    """Largest entry of the whitened covariance of the fit list minus the identity; vectors are centred before they are multiplied."""
    k = len(model.values)

    def run(batches):
        total, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = model.whitened(_matrix(batch.column(0), d))
            total, mean = total + w.T @ w, mean + w.sum(axis=0)
        rows = [(i, j, float(total[i, j])) for i in range(k) for j in range(k)] + [(i, -1, float(mean[i])) for i in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["i", "j", "v"])

    sums = {(r.i, r.j): r.v / model.n for r in fit.mapInArrow(tidy(run), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    return max(abs(sums[i, j] - sums[i, -1] * sums[j, -1] - (i == j)) for i in range(k) for j in range(k))


def _deviations(y: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sum of (n y - S)^2 of every row."""
    n, s = model.n, model.sums
    largest = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    bits = largest.bit_length() + max(largest, *map(abs, s)).bit_length() + len(s).bit_length()
    y = y.astype(object) if bits > 62 else y
    squares, dots, rest = (y * y).sum(axis=1), (y * np.array(s, dtype=y.dtype)).sum(axis=1), sum(v * v for v in s)
    exact = (n * n * int(q) - 2 * n * int(t) + rest for q, t in zip(squares, dots))
    return [v if v < 2**63 else None for v in exact]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every sound row."""
    vectors = _cleaned(rows, id_col, vector_col, scale)
    schema = f"vec_id {sql_type(vectors, 'vec_id')}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model, d = fitted(vectors, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k, kind = len(model.values), arrow_type(vectors, "vec_id")
    share = np.array([float(v / model.trace) for v in model.values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(1), d)
            m = len(y)
            again = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(kind).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                 pa.array(_deviations(y, model), pa.int64()).take(again), pa.array(model.whitened(y).ravel()), pa.array(np.tile(share, m)),
                 pa.array(np.full(m * k, model.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.filter(F.size("y") == d).mapInArrow(tidy(run), schema)
