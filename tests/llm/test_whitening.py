"""Whitening against numpy and brute force, and the exact polynomial against its definition."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest

from fieldspark.llm import charpoly, whitening
from fieldspark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, y string, n int, component string, whitened array<int>"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, None, [2]) for i, v in rows], SCHEMA).repartition(4)


def check(got, rows, scale=64, components=16):
    """The contract's columns, from the rows themselves."""
    sound = [(i, [math.floor(scale * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
             if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in sound})
    n, d = len(fit), len(fit[0])
    s = [sum(v[k] for v in fit) for k in range(d)]
    x = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s)] for v in fit])
    e, u = np.linalg.eigh(x.T @ x / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, sum(e > 1e-9 * e[0]))
    assert len(got) == k * len(sound)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9
    for i, v in sound:
        assert sorted(by[i, sum((n * a - b) ** 2 for a, b in zip(v, s))]) == list(range(1, k + 1))
    table = {tuple(v): [w[0] for _, w in sorted(by[i, sum((n * a - b) ** 2 for a, b in zip(v, s))].items())] for i, v in sound}
    w = np.array([table[v] for v in fit])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    gaps = np.abs(np.diff(e))
    for c in range(k):
        if (c == 0 or gaps[c - 1] > 1e-6 * e[0]) and (c == d - 1 or gaps[c] > 1e-6 * e[0]):
            want = x @ u[:, c] / np.sqrt(e[c])
            assert min(np.abs(w[:, c] - want).max(), np.abs(w[:, c] + want).max()) < 1e-7


def test_random_vectors_with_awkward_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in rng.normal(0, 0.3, 20)]) for k in range(300)]
    rows += [(300 + k, rows[0][1]) for k in range(90)] + [(7, rows[7][1]), (None, rows[9][1])]
    bad = [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19), (904, [-float("inf")] * 20)]
    check(whitening.whiten(frame(spark, rows + bad)).collect(), rows)
    ragged = [(905, [1.0]), (906, []), (907, [1.0] * 21)]
    assert whitening.whiten(frame(spark, rows + bad + ragged)).count() == 16 * len(rows)


def test_rank_and_multiple_values(spark):
    """A plane in space, and equal variances along three axes."""
    plane = [(k, [a / 4, b / 2, a / 4 + b / 2, 0.5]) for k, (a, b) in enumerate(itertools.product(range(-5, 6), range(-4, 5)))]
    got = whitening.whiten(frame(spark, plane)).collect()
    check(got, plane)
    assert {r.component for r in got} == {1, 2}
    cube = [(k, [float(c) for c in v]) for k, v in enumerate(itertools.product((-1, 1), repeat=3))]
    got = whitening.whiten(frame(spark, cube), components=2).collect()
    check(got, cube, components=2)


def test_nothing_varies(spark):
    for rows in ([], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])], [(1, []), (2, [])], [(1, None)]):
        assert whitening.whiten(frame(spark, rows)).collect() == []


def test_sums_of_huge_entries_are_exact(spark):
    rng = np.random.default_rng(6)
    y = [[int(v) for v in rng.integers(-(2**62), 2**62, 3)] for _ in range(50)] + [[2**63 - 1, -(2**63), 0]]
    got = whitening._sums(spark.createDataFrame([(v,) for v in y], "y array<long>").repartition(7), 3)
    rows = [[*v, 1] for v in y]
    assert got == [[sum(r[i] * r[j] for r in rows) for j in range(4)] for i in range(4)]
    big = [(k, [float(v) for v in rng.integers(-1000, 1000, 3) * 2.0**8]) for k in range(40)]
    check(whitening.whiten(frame(spark, big)).collect(), big)
    beyond = [(k, [c * 2.0**12 for c in v]) for k, v in big]
    assert {r.deviation for r in whitening.whiten(frame(spark, beyond)).collect()} == {None}


def poly(roots):
    f = [1]
    for r in roots:
        f = [a - r * b for a, b in zip([0, *f], [*f, 0])]
    return f


def test_polynomial_is_exact():
    rng = np.random.default_rng(7)
    for d in (1, 2, 3, 6):
        b = rng.integers(-9, 9, (d + 1, d)).astype(object)
        m = [[int(v) for v in row] for row in b.T @ b]
        ps = charpoly.primes_beyond(charpoly.coefficient_bound(d, sum(m[i][i] for i in range(d))))
        f = charpoly.remaindered(charpoly.modular_polynomials(m, ps).tolist(), ps)
        for x in range(-2, d):  # det(x - m) by Leibniz' formula
            det = sum((-1) ** sum(p[i] > p[j] for i in range(d) for j in range(i + 1, d)) * math.prod((x if i == p[i] else 0) - m[i][p[i]] for i in range(d))
                      for p in itertools.permutations(range(d)))
            assert sum(c * x**k for k, c in enumerate(f)) == det


def test_factors_and_roots():
    f = poly([3, 3, 3, 5, 5, 8, 10**12, 10**12 + 1, 0, 0])
    assert sorted((m, g) for m, g in charpoly.squarefree_factors(f)) == sorted([(1, poly([8, 10**12, 10**12 + 1])), (2, poly([0, 5])), (3, [-3, 1])])
    roots = charpoly.largest_roots(f, 6)
    assert [(round(r.value), r.multiplicity) for r in roots][:5] == [(10**12 + 1, 1), (10**12, 1), (8, 1), (5, 2), (3, 3)]
    assert all(abs(r.value - round(r.value)) < Fraction(1, 2**100) for r in roots)
    close = [2**80 * a for a in (1, 2)] + [2**81 + 1]
    assert [round(r.value) for r in charpoly.largest_roots(poly(close), 3)] == sorted(close, reverse=True)


def test_query(spark, sf):
    got = QUERIES["op12_embedding_whitening"](spark, sf)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(got.collect(), rows)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
