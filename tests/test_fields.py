"""Outlines, zonal sums, remaps and fills against brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldspark.operators import align, outlines, regrid, relax, zonal
from fieldspark.operators.outlines import Grid


def to_frame(spark, a, name="v", **const):
    iy, ix = np.indices(a.shape)
    pdf = pd.DataFrame({"iy": iy.ravel(), "ix": ix.ravel(), name: a.ravel(), **const})
    return spark.createDataFrame(pdf).withColumn(name, F.nanvl(name, F.lit(None)))


def to_array(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["iy"], r["ix"]] = np.nan if r[name] is None else r[name]
    return out


@pytest.fixture(scope="module")
def cube(spark):
    iy, ix = np.indices((6, 8))
    pdf = pd.concat([pd.DataFrame({"t": t, "iy": iy.ravel(), "ix": ix.ravel(), "a": (iy * 8 + ix).ravel() * (t + 1.0), "m": 1}) for t in range(2)])
    pdf.loc[(pdf.iy == 1) & (pdf.ix == 1), "a"] = np.nan
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def boxes(spark):
    ring = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    rows = [("A", 0, ring(0.0, 0.0, 3.0, 3.0)), ("B", 0, ring(2.0, 2.0, 5.2, 4.0)), ("far", 0, ring(90.0, 90.0, 91.0, 91.0))]
    return outlines.edges_from_rings(spark.createDataFrame(rows, "region string, ring int, points array<struct<x:double,y:double>>"))


def test_zonal_sums(spark, cube, boxes):
    mask = outlines.centre_cells(boxes, check=True)
    out = zonal.zonal_sum(cube, mask, {"a": F.col("a")}, {"m": F.col("m")}, regions=boxes.select("region"))
    got = {(r.region, r.t): (r.a, r.m) for r in out.collect()}
    cells = {"A": [(y, x) for y in range(3) for x in range(3)], "B": [(y, x) for y in range(2, 4) for x in range(2, 5)], "far": []}
    for (reg, t), (a, m) in got.items():
        assert a == sum((y * 8 + x) * (t + 1.0) for y, x in cells[reg] if (y, x) != (1, 1)) and m == len(cells[reg])
    assert len(got) == 6
    total = {r.t: r.a for r in zonal.with_grand_total(out, ["a", "m"]).where("region = 'total'").collect()}
    assert total[0] == got["A", 0][0] + got["B", 0][0]
    again = zonal.with_grand_total(zonal.with_grand_total(out, ["a", "m"]), ["a", "m"])
    assert again.where("region = 'total'").count() == 2
    assert zonal.union_mask(mask, "all").count() == 15
    # beyond the broadcast bound the join shuffles and gives the same
    big = zonal.zonal_sum(cube, mask, {"a": F.col("a")}).collect()
    assert {(r.region, r.t): r.a for r in big} == {k: x[0] for k, x in got.items() if k[0] != "far"}


def test_zonal_reads_input_once(spark, tmp_path, cube, boxes):
    cube.write.parquet(str(tmp_path / "c"))
    src = spark.read.parquet(str(tmp_path / "c"))
    plan = zonal.zonal_sum(src, outlines.centre_cells(boxes), {"a": F.col("a")})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_empty_outlines_raise(boxes):
    with pytest.raises(ValueError):
        outlines.centre_cells(boxes.where("false"), check=True)


def test_touched_cells(boxes):
    got = {(r.iy, r.ix) for r in outlines.touched_cells(boxes).where("region = 'B'").collect()}
    assert {(y, x) for y in (2, 3) for x in (2, 3, 4, 5)} <= got and max(x for _, x in got) == 5


def test_wkt(spark):
    d = spark.createDataFrame([("r", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2))")], "region string, wkt string")
    e = outlines.edges_from_wkt(d).withColumn("is_hole", F.col("ring") == 1)
    assert e.count() == 8 and outlines.polygon_area(e).first().area == 15.0
    assert outlines.centre_cells(e).count() == 15


def test_bilinear_is_exact_on_planes(spark):
    iy, ix = np.indices((9, 7))
    src = to_frame(spark, 2.0 * (ix + 0.5) - 3.0 * (iy + 0.5) + 1)
    t = spark.createDataFrame([(0, 0, 2.3, 4.9), (0, 1, 6.1, 1.2), (1, 0, 50.0, 50.0)], "ty int, tx int, sx double, sy double")
    got = {(r.ty, r.tx): r.v for r in regrid.bilinear(t, src, ["v"]).collect()}
    assert got[0, 0] == pytest.approx(2 * 2.3 - 3 * 4.9 + 1) and got[0, 1] == pytest.approx(2 * 6.1 - 3 * 1.2 + 1) and got[1, 0] is None


def test_conservative_keeps_the_integral(spark):
    a = np.random.default_rng(0).random((12, 10))
    dst = Grid(dx=2.5, dy=1.5)
    out = regrid.conservative(to_frame(spark, a), ["v"], Grid(), dst)
    assert out.agg(F.sum("v")).first()[0] * 2.5 * 1.5 == pytest.approx(a.sum())


@pytest.mark.parametrize("boundary, tile, tol", [("neumann", 8, 1e-7), ("dirichlet", 32, 1e-9), ("periodic", 8, 1e-7)])
def test_laplace(spark, boundary, tile, tol):
    rng = np.random.default_rng(3)
    a = rng.random((22, 19))
    gap = np.zeros(a.shape, dtype=bool)
    gap[0:9, 3:14], gap[12:22, 8:19] = True, True
    b = np.where(gap, np.nan, a)
    two = to_frame(spark, b, s=0).unionByName(to_frame(spark, a, s=1))
    got = to_array(relax.laplace_fill(two, "v", 22, 19, ["s"], boundary, tile=tile, tol=tol).where("s = 0"), a.shape)
    pts = list(zip(*np.nonzero(gap)))
    no = {p: i for i, p in enumerate(pts)}
    m, rhs = np.zeros((len(pts), len(pts))), np.zeros(len(pts))
    for (y, x), i in no.items():
        for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            q = (y + dy, x + dx)
            if boundary == "periodic":
                q = (q[0] % 22, q[1] % 19)
            if not (0 <= q[0] < 22 and 0 <= q[1] < 19):
                m[i, i] += boundary == "dirichlet"
                continue
            m[i, i] += 1
            if q in no:
                m[i, no[q]] -= 1
            else:
                rhs[i] += a[q]
    want = a.copy()
    want[tuple(zip(*pts))] = np.linalg.solve(m, rhs)
    np.testing.assert_allclose(got, want, atol=max(20 * tol, 1e-7))
    with pytest.raises(ValueError):
        relax.laplace_fill(two, "v", 22, 19, ["s"], "open")


def test_laplace_rounds_do_not_grow_with_the_hole(spark):
    """Holes of 2 x 2 and of 6 x 6 tiles between known edges of x^2 - y^2, which the stencil leaves alone."""
    rounds = []
    for n in (18, 50):
        seen = []
        axis = np.arange(n) / n
        plane = np.subtract.outer(axis**2, axis**2)
        hole = plane.copy()
        hole[1:-1, 1:-1] = np.nan
        out = relax.laplace_fill(to_frame(spark, hole), "v", n, n, tile=8, tol=1e-4, on_round=lambda k, r: seen.append(r))
        np.testing.assert_allclose(to_array(out, plane.shape), plane, atol=1e-3)
        rounds.append(len(seen))
    assert rounds[1] <= rounds[0] + 3 and max(rounds) < 15, rounds


def test_laplace_ends_where_numbers_end(spark):
    a = np.arange(36.0).reshape(6, 6)
    a[2:4, 1:5] = np.nan
    out = relax.laplace_fill(to_frame(spark, a), "v", 6, 6, tile=3, tol=0.0)
    assert not np.isnan(to_array(out, a.shape)).any()


def test_merge_conflict_raises(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    b = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 1.0)], "k int, v double")
    assert sorted(r.v for r in align.merge_layers(a, b, ["k"], ["v"]).collect()) == [1.0, 2.0, 5.0]
    with pytest.raises(PySparkException, match="conflicting"):
        align.merge_layers(a, b.withColumn("v", F.col("v") + 1), ["k"], ["v"]).collect()


@pytest.mark.parametrize("scale", [1.0, 2.5e5])
def test_boxes_of_all_sizes_meet(spark, scale):
    """Boxes from points to continents, in degrees and in metres, against every pair; few rows a box."""
    rng = np.random.default_rng(11)
    boxes = []
    for n in (60, 50):
        low = rng.uniform(-40, 40, (n, 2)) * scale
        side = np.exp(rng.uniform(-9, 4, (n, 2))) * scale * (rng.random((n, 1)) > 0.1)
        boxes.append(np.hstack([low, low + side]))
    boxes[1][0] = boxes[0][0]
    boxes[1][1] = [boxes[0][1][2], boxes[0][1][3], boxes[0][1][2] + scale, boxes[0][1][3] + scale]  # touches in a corner
    frame = lambda name, b: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(b)], f"{name} long, xmin double, ymin double, xmax double, ymax double")
    left, right = frame("lid", boxes[0]), frame("rid", boxes[1])
    want = {(i, j) for i, a in enumerate(boxes[0]) for j, b in enumerate(boxes[1]) if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]}
    got = [tuple(r) for r in outlines.overlapping_boxes(left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    foot = right.withColumnsRenamed({"rid": "code"}).withColumn("order", -F.col("code"))
    inside = {i: max((j for j, b in enumerate(boxes[1]) if b[0] <= a[0] and b[1] <= a[1] and b[2] >= a[2] and b[3] >= a[3]), default=None) for i, a in enumerate(boxes[0])}
    assert {r.lid: r.code for r in outlines.containing_code(left, foot).collect()} == inside
    homes = outlines._tiles(outlines._leveled(left, "xmin", "xmax", "ymin", "ymax"), F.col("__l"), "xmin", "xmax", "ymin", "ymax")
    assert homes.groupBy("lid").count().agg(F.max("count")).first()[0] <= 4


def test_points_in_polygons_of_all_sizes(spark):
    rng = np.random.default_rng(12)
    rings, points = [], []
    for k in range(14):
        centre, r, n = rng.uniform(-1e5, 1e5, 2), np.exp(rng.uniform(0, 11)), int(rng.integers(3, 200))
        a = np.sort(rng.uniform(0, 2 * np.pi, n))
        radius = r * rng.uniform(0.5, 1.0, n)
        rings.append((f"P{k}", 0, [tuple(map(float, p)) for p in np.stack([centre[0] + radius * np.cos(a), centre[1] + radius * np.sin(a)], 1)]))
        points += [tuple(map(float, centre + rng.normal(0, r, 2))) for _ in range(12)]
    edges = outlines.edges_from_rings(spark.createDataFrame(rings, "region string, ring int, points array<struct<x:double,y:double>>"))
    p = spark.createDataFrame([(k, *xy) for k, xy in enumerate(points)], "pid long, px double, py double")

    def inside(x, y, ring):
        return sum((y0 <= y) != (y1 <= y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1])) % 2

    want = {(k, name) for k, (x, y) in enumerate(points) for name, _, ring in rings if inside(x, y, ring)}
    assert {tuple(r) for r in outlines.points_in_polygons(p, edges).select("pid", "region").collect()} == want


@pytest.mark.parametrize("radius", [0.5, 1.0, 2.3, 5.0])
def test_buffers_against_distances(spark, radius):
    rng = np.random.default_rng(13)
    cells = {(k, int(y), int(x)) for k in "ab" for y, x in rng.integers(-12, 12, (25, 2))}
    df = spark.createDataFrame([(*c, 1) for c in cells] + [(*c, 2) for c in list(cells)[:5]], "k string, iy long, ix long, n int")
    want = {(k, y + dy, x + dx) for k, y, x in cells for dy in range(-6, 7) for dx in range(-6, 7) if dy * dy + dx * dx <= radius * radius}
    got = [tuple(r) for r in outlines.dilate(df, radius, ["k"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_wide_buffer_has_few_spans(spark):
    """A block of cells with radius 500: one span a row on the way, and no literals of a disc in the plan."""
    block = spark.range(100 * 100).select(F.floor(F.col("id") / 100).alias("iy"), (F.col("id") % 100).alias("ix"))
    assert outlines.row_spans(block).count() == 100
    out = outlines.dilate(block, 500.0)
    n = out.count()
    assert n == 100 * (100 + 2 * 500) + 2 * sum(100 + 2 * int((500**2 - d * d) ** 0.5) for d in range(1, 501))
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 4000
    assert outlines.dilate(block.limit(0), 3.0).count() == 0


def test_many_layers_merge_in_one_exchange(spark):
    a = spark.createDataFrame([(1, 2.0, 7), (2, None, 8)], "k int, v double, a int")
    b = spark.createDataFrame([(1, 2.0, 1), (2, 5.0, 2), (3, 1.0, 3)], "k int, v double, b int")
    c = spark.createDataFrame([(4, None, 9)], "k int, v double, c int")
    got = {r.k: (r.v, r.a, r.b, r.c) for r in align.merge_many([a, b, c], ["k"], ["v"]).collect()}
    assert got == {1: (2.0, 7, 1, None), 2: (5.0, 8, 2, None), 3: (1.0, None, 3, None), 4: (None, None, None, 9)}
    with pytest.raises(PySparkException, match="conflicting"):
        align.merge_many([a, b.withColumn("v", F.col("v") + 1), c], ["k"], ["v"]).collect()


def test_mosaic_rules(spark):
    t = spark.createDataFrame([(0, 0, 2, 0.0), (0, 0, 1, 3.0), (0, 1, 1, None), (0, 1, 2, 4.0)], "iy int, ix int, o int, v double")
    pick = lambda rule: {(r.iy, r.ix): r.v for r in regrid.mosaic(t, "v", rule, "o").collect()}
    assert pick("max") == {(0, 0): 3.0, (0, 1): 4.0} and pick("first") == {(0, 0): 3.0, (0, 1): 4.0} and pick("sum") == {(0, 0): 3.0, (0, 1): 4.0}
    with pytest.raises(ValueError):
        regrid.mosaic(t, "v", "min")


def test_bilinear_slices_return_every_target(spark):
    from fieldspark.operators import regrid

    src = spark.createDataFrame([(m, y, x, float(m + y + x)) for m in (1, 2) for y in range(4) for x in range(4)], "month int, iy bigint, ix bigint, a double")
    t = spark.createDataFrame([(y, x, x + 0.5, y + 0.5) for y in range(8) for x in range(8)], "ty bigint, tx bigint, sx double, sy double")
    out = regrid.bilinear(t, src, ["a"], slices=["month"])
    assert out.count() == 128 and out.where("a is null").count() == 2 * (64 - 16)


def test_missing_chunk_gives_missing_rows(spark):
    import os

    from fieldspark.session import scratch_path
    from fieldspark.sources import chunkstore

    path = scratch_path(spark, "holes")
    df = spark.createDataFrame([(0, y, x, 1.0) for y in range(8) for x in range(8)], "t bigint, iy bigint, ix bigint, value double")
    chunkstore.write_store(df, path, "v", (1, 8, 8), (1, 4, 4), {})
    os.remove(f"{path.removeprefix('file:')}/v/0.1.1")
    out = chunkstore.open_store(spark, path, "v")
    assert out.count() == 64 and out.where("value is null").count() == 16


def test_deep_specs_and_functions_of_several_arrays(spark):
    import numpy as np

    from fieldspark.functions import text
    from fieldspark.operators import arrays

    doc = '{"a": {"b": {"c": {"d": {"e": {"distribution": "norm"}}, "x": 1}}}, "f": {"distribution": "norm", "derived_from": "a"}}'
    got = text.flatten_specs(spark.createDataFrame([(1, doc)], "doc int, text string"), "doc", "text").collect()
    assert sorted((r["name"], r["error"]) for r in got) == [("a.b.c.d.e", None), ("f", "both")]
    deep = '{"k": ' * 300 + '{"distribution": 1, "loc": [1, "x"]}' + "}" * 300
    odd = [(2, deep), (3, None), (4, "[1, 2]"), (5, '{"a": {"distribution": null, "derived_from": null, "x": {"derived_from": "b"}}, "b": "distribution", "c": []}'), (None, "{}")]
    rows = text.flatten_specs(spark.createDataFrame(odd, "doc int, text string").repartition(2), "doc", "text").collect()
    assert sorted((r["doc"], r["name"], r["distribution"], r["derived_from"], r["spec"]) for r in rows) == [
        (2, ".".join(["k"] * 300), "1", None, '{"distribution":1,"loc":[1,"x"]}'), (5, "a.x", None, "b", '{"derived_from":"b"}')]
    with pytest.raises(PySparkException):
        text.flatten_specs(spark.createDataFrame([(1, "{")], "doc int, text string"), "doc", "text").collect()
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0]), (2, None, [1.0, 1.0]), (3, [0.0, 1.0], None)], "k int, a array<double>, b array<double>")
    dot = arrays.core_function(lambda a, b: (a * b).sum(axis=1), "double")
    assert {r["k"]: r["d"] for r in df.select("k", dot(F.col("a"), F.col("b")).alias("d")).collect()} == {1: 11.0, 2: None, 3: None}
    assert np.isfinite(11.0)


def test_missing_and_zero_spread(spark):
    from fieldspark.operators import calibrate, scan

    nan = float("nan")
    df = spark.createDataFrame([("k", x) for x in (0.0, 1.0, 2.0, 3.0, 4.0, nan)], "k string, v double")
    assert scan.exact_quantiles(df, ["k"], "v", [0.5]).first()["q0"] == 2.0
    obs = spark.createDataFrame([("k", 1.0, 1.5, 0.5), ("k", 1.0, 2.0, 0.0), ("k", 2.0, 2.0, 0.0)], "k string, x double, mu double, s double")
    args = (F.col("x"), F.col("mu"), F.col("s"))
    one = calibrate.mean_log_likelihood(obs, ["k"], calibrate.log_normal(*args)).first()[1]
    two = calibrate.mean_log_likelihood(obs, ["k"], calibrate.log_pseudo_huber(*args)).first()[1]
    assert abs(one - (-0.5 - 0.5 * 0.4515827052894548)) < 1e-9 and two == float("-inf")
