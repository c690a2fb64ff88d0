"""Top-k by inner product against brute force, with ties, copies and awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import voronoi
from fieldspark.llm.voronoi import HIGHEST, LOWEST

SCHEMA = "vec_id long, embedding array<double>, query string, y int, rank double, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "q", 1, 0.0, "s") for i, v in rows], SCHEMA).repartition(5)


def expected(rows, top=5):
    sound = [(i, [min(max(math.floor(256 * c), LOWEST), HIGHEST) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, q) in enumerate(sound):
        if i is not None and i % 50 == 0:
            scored = [(-min(max(sum(x * y for x, y in zip(q, c)), LOWEST + 1), HIGHEST), j is None, j or 0) for b, (j, c) in enumerate(sound) if a != b]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(seed, n, d=6, spread=0.4, centres=12):
    """Clusters of several lengths, some points being copies."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (centres, d)) * rng.uniform(0.1, 3, (centres, 1))
    rows = [(k, (middle[k % centres] + rng.normal(0, spread, d)).tolist()) for k in range(n)]
    return rows + [(n + k, rows[3][1]) for k in range(n // 3)]


@pytest.mark.parametrize(("spread", "group"), [(0.4, 1 << 23), (0.01, 200), (0.01, 64), (0.0, 1 << 23)])
def test_equals_brute_force(spark, spread, group):
    rows = vectors(1, 600, spread=spread)
    df = voronoi.top_scores(frame(spark, rows), F.col("vec_id") % 50 == 0, pivots=16, group_bytes=group)
    assert got(df) == expected(rows)


def test_awkward_rows(spark):
    rows = vectors(2, 120) + [(50, [0.1] * 6), (50, [0.1] * 6), (None, [2.0] * 6), (None, None), (200, None), (250, [None] * 6), (300, [float("nan")] * 6),
                              (350, [float("inf")] * 6), (400, []), (450, [1.0]), (500, [9.0] * 8), (-100, [-1.0] * 6)]
    assert got(voronoi.digest(frame(spark, rows))) == expected(rows)


def test_few_rows(spark):
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (1, [0.5]), (50, [-1.0])], [(1, [1.0])], [(0, []), (50, [])], [(0, None)]):
        assert got(voronoi.digest(frame(spark, rows))) == expected(rows)
    assert [t for _, t in voronoi.digest(frame(spark, [])).dtypes] == ["bigint", "int", "bigint", "bigint"]


@pytest.mark.parametrize("size", [2.0**18, 2.0**22, 2.0**30, 2.0**60])
def test_large_components_stay_exact(spark, size):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.integers(-1000, 1000, 3) * size / 1000).tolist()) for k in range(120)]
    assert got(voronoi.digest(frame(spark, rows))) == expected(rows)


def test_bounds_leave_far_cells_out(spark):
    """Narrow clusters on long axes: vectors are sent to few groups, and to one block each."""
    rng = np.random.default_rng(4)
    rows = [(k, (np.eye(8)[k % 8] * 4 + rng.normal(0, 0.01, 8)).tolist()) for k in range(1600)]
    cleaned = voronoi._cleaned(frame(spark, rows), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 256)
    pivots = np.floor(np.eye(8) * 1024)
    placed = voronoi._placed(cleaned, pivots, 8, "<i2")
    cells = voronoi._summary(placed, pivots, 5)
    routed = voronoi._routed(placed, cells, "<i2", 8, len(rows), 8)
    assert routed.filter("vector").count() == 800  # the four cells with queries, each once
    best = voronoi._solved(routed, "<i2", 8, 40, 5)
    assert best.count() >= 5 * 32
