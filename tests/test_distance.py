"""The distance transform against a search over all valid cells."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import distance


def nearest(cells, k):
    """{(iy, ix): value or None} of {(iy, ix): value}, gaps filled from the k nearest valid cells."""
    valid = [(p, v) for p, v in cells.items() if v is not None]
    out = {}
    for (y, x), v in cells.items():
        if v is None and valid:
            best = sorted(((a - y) ** 2 + (b - x) ** 2, a, b, w) for (a, b), w in valid)[:k]
            weight = [1 / math.sqrt(d) for d, *_ in best]
            v = sum(q * w for q, (*_, w) in zip(weight, best)) / sum(weight)
        out[y, x] = v
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for p, v in want.items():
        assert (got[p] is None) == (v is None) and (v is None or abs(got[p] - v) < 1e-9), (p, got[p], v)


def grid(seed, h, w, holes=0.15, absent=0.0, deep=True, step=1, off=0):
    rng = np.random.default_rng(seed)
    a = rng.random((h, w))
    gone = rng.random((h, w)) < holes
    if deep:
        gone[h // 5: 4 * h // 5, w // 6: 5 * w // 6] = True
    keep = rng.random((h, w)) >= absent
    return {(y * step + off, x * step - off): None if gone[y, x] else float(a[y, x]) for y in range(h) for x in range(w) if keep[y, x]}


@pytest.mark.parametrize("k", [1, 2, 4])
@pytest.mark.parametrize("band", [3, 7, 64])
def test_against_search(spark, k, band):
    slices = {"a": grid(1, 30, 26), None: grid(2, 17, 40, absent=0.3, deep=False), "far": grid(3, 9, 9, step=1000, off=-500_000, absent=0.2),
              "none": {(y, x): None for y in range(4) for x in range(4)}, "one": {(5, 5): 2.0, **{(y, 0): None for y in range(12)}},
              "whole": {(0, 0): 1.0, (0, 1): 2.0}, "few": {(0, 0): 1.0, (0, 9): 3.0, (0, 3): None, (70, 3): None}}
    rows = [(s, y, x, v if v is not None else (float("nan") if (x + y) % 2 else None), "z") for s, cells in slices.items() for (y, x), v in cells.items()]
    field = spark.createDataFrame(rows, "s string, iy int, ix int, v double, fill string").repartition(4)
    out = distance.fill_gaps(field, "v", neighbours=k, slices=["s"], band=band)
    assert set(out.columns) == {"s", "iy", "ix", "v", "fill"} and dict(out.dtypes)["iy"] == "int"
    got = {}
    for r in out.collect():
        got.setdefault(r.s, {})[r.iy, r.ix] = r.v
    for s, cells in slices.items():
        same(got[s], nearest(cells, k))


def test_ties_go_by_row_then_column(spark):
    """Rings of equal distance around gaps, over several bands."""
    cells = {(y, x): float(100 * y + x) if (y % 8 in (0, 5) and x % 7 in (0, 4)) else None for y in range(24) for x in range(21)}
    for k in (1, 3):
        field = spark.createDataFrame([(y, x, v) for (y, x), v in cells.items()], "iy long, ix long, v double")
        out = distance.fill_gaps(field, "v", neighbours=k, band=5)
        same({(r.iy, r.ix): r.v for r in out.collect()}, nearest(cells, k))


def test_several_values_in_one_pass(spark):
    a, b = grid(5, 12, 14), grid(6, 12, 14, deep=False)
    field = spark.createDataFrame([(*p, a[p], b[p], 7) for p in a], "iy long, ix long, a double, b double, n int")
    out = distance.fill_gaps(field, ["a", "b"], band=6).collect()
    same({(r.iy, r.ix): r.a for r in out}, nearest(a, 1))
    same({(r.iy, r.ix): r.b for r in out}, nearest(b, 1))
    assert {r.n for r in out} == {7}


def test_empty_and_complete_fields(spark):
    none = spark.createDataFrame([], "iy long, ix long, v double")
    assert distance.fill_gaps(none, "v").collect() == []
    full = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "iy long, ix long, v double")
    assert sorted(distance.fill_gaps(full, "v").collect()) == sorted(full.collect())


def test_plan_has_no_join_of_gaps_with_cells(spark):
    """The exchanges are by band and by cell; valid cells away from the hole do not travel on."""
    cells = {(y, x): None if 40 <= y < 50 and 20 <= x < 30 else 1.0 for y in range(128) for x in range(64)}
    field = spark.createDataFrame([(y, x, v) for (y, x), v in cells.items()], "iy long, ix long, v double")
    out = distance.fill_gaps(field, "v")
    assert out.where(F.col("v") != 1).isEmpty()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan
