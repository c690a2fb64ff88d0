"""Scoring, sampling and checks: brute force, closed forms and error contracts."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldspark.functions import distributions as dist
from fieldspark.functions import projection as pj
from fieldspark.functions import text as fx
from fieldspark.functions import units
from fieldspark.operators import calibrate as c
from fieldspark.operators import design as d
from fieldspark.operators import quality
from fieldspark.plans import forcing


@pytest.mark.parametrize("shape", [(40, 33), (70, 64), (5, 90), (31, 31)])
def test_decorrelation_length(spark, shape):
    rng = np.random.default_rng(0)
    ny, nx = shape
    yy, xx = np.indices(shape)
    fields = {"wave": np.sin(yy / 4.0) + np.cos(xx / 5.0) + 0.1 * rng.normal(size=shape), "noise": rng.normal(size=shape),
              "ramp": yy * 1.0, "empty": np.full(shape, np.nan), "flat": np.full(shape, 3.0), "column": xx % 2 * 1.0}
    fields["wave"][3:6, 4:9] = np.nan
    pdf = pd.concat([pd.DataFrame({"f": n, "iy": yy.ravel(), "ix": xx.ravel(), "v": a.ravel()}) for n, a in fields.items()])
    got = {r.f: r.length for r in c.decorrelation_length(spark.createDataFrame(pdf), "v", ny, nx, ["f"], pixel=10.0, band=16).collect()}
    for name, a in fields.items():
        if name == "empty":
            assert got[name] is None
            continue
        b = np.nan_to_num(a - np.nanmean(a))
        acf = np.fft.fftshift(np.fft.ifft2(np.abs(np.fft.fft2(b)) ** 2).real)
        r = np.hypot(yy - ny // 2, xx - nx // 2).astype(int).ravel()
        radial = np.bincount(r, acf.ravel() / acf.max()) / np.bincount(r)
        rmax = min(ny // 2, nx // 2)
        below = np.nonzero(radial[: rmax + 1] < math.exp(-1))[0]
        assert got[name] == 10.0 * (below[0] if below.size else rmax), name


@pytest.mark.parametrize("block", [1, 3, 8, 100])
def test_blocks_and_bootstrap(spark, block):
    rng = np.random.default_rng(2)
    obs, sim = rng.normal(size=(13, 11)), rng.normal(size=(4, 13, 11))
    sim[2, 5:8, 3:6] = np.nan
    iy, ix = np.indices(obs.shape)
    pdf = pd.concat([pd.DataFrame({"exp_id": e, "iy": iy.ravel(), "ix": ix.ravel(), "sim": s.ravel(), "obs": obs.ravel()}) for e, s in enumerate(sim)])
    blocks = c.squared_error_blocks(spark.createDataFrame(pdf), block)
    got = {(r.exp_id, r.by, r.bx): (r.s, r.c) for r in blocks.collect()}
    ok = np.isfinite(sim).all(axis=0)
    by, bx = min(block, 13), min(block, 11)
    for e in range(4):
        for j in range(13 // by):
            for i in range(11 // bx):
                part = (slice(j * by, (j + 1) * by), slice(i * bx, (i + 1) * bx))
                n = ok[part].sum()
                if n:
                    s, k = got.pop((e, j, i))
                    assert k == n and s == pytest.approx(((sim[e] - obs)[part][ok[part]] ** 2).sum())
    assert not got
    rmse = c.bootstrap_rmse(blocks, n_boot=40, seed=5, chunk=3)
    sums = {(r.exp_id, r.by, r.bx): (r.s, r.c) for r in blocks.collect()}
    places = sorted({k[1:] for k in sums})
    n, want = len(places), {}
    for boot in range(40):
        drawn = []
        chunks = np.bincount((c.draw_indices(5, boot, 0, np.arange(n), n) // np.uint64(3)).astype(int))
        for k, m in enumerate(chunks):
            drawn += [places[3 * k + int(i)] for i in c.draw_indices(5, boot, k + 1, np.arange(m), min(3, n - 3 * k))]
        assert len(drawn) == n
        for e in range(4):
            s, k = (sum(sums[e, *p][i] for p in drawn) for i in (0, 1))
            want[e, boot] = math.sqrt(s / max(k, 1))
    assert {(r.exp_id, r.boot): pytest.approx(r.rmse) for r in rmse.collect()} == want
    ranked = c.rank_members(rmse).collect()
    assert min(ranked, key=lambda r: r.rmse_mean).tied_with_best


def test_draws_are_uniform_and_differ():
    """Counts of a chunk's draws over resamples against the multinomial law."""
    x = np.array([np.bincount(c.draw_indices(1, boot, 0, np.arange(1000), 50).astype(int), minlength=50) for boot in range(400)])
    assert (x.sum(axis=1) == 1000).all() and abs(x.mean() - 20) < 1e-9
    assert abs(x.var() - 1000 * 0.02 * 0.98) < 1.0 and np.abs(x.mean(axis=0) - 20).max() < 1.2
    assert np.abs(np.corrcoef(x[:, 0], x[:, 1:].T)[0, 1:]).mean() < 0.1


def test_bootstrap_without_blocks(spark):
    none = spark.createDataFrame([], "exp_id int, by long, bx long, s double, c long")
    assert c.bootstrap_rmse(none, 10).collect() == []


def test_resampling(spark):
    w = spark.createDataFrame([(i, x) for i, x in enumerate((0.5, 0.0, 0.3, 0.2))], "exp_id int, w double")
    n = {r.exp_id: r["n"] for r in c.draw_counts(c.resample(w, "exp_id", "w", 4000), "exp_id").collect()}
    assert sum(n.values()) == 4000 and 1 not in n and abs(n[0] - 2000) < 150
    bad = c.resample(w.withColumn("w", F.lit(None).cast("double")), "exp_id", "w", 4000)
    assert {r.exp_id: r["count"] for r in bad.groupBy("exp_id").count().collect()}.keys() == {0, 1, 2, 3}
    named = w.withColumn("exp_id", F.concat(F.lit("same_prefix_"), F.col("exp_id").cast("string")))
    assert c.resample(named, "exp_id", "w", 500).count() == 500


def test_likelihoods(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, -1.0, 1.0), (0, float("nan"), 1.0), (1, -1.0, -2.0)], "e int, x double, m double")
    assert {r.e: r.log_likelihood for r in c.log_jaccard(df, ["e"], "x", "m").collect()} == {0: -0.5, 1: -0.0}
    one = c.mean_log_likelihood(df.where("e = 1"), ["e"], c.log_normal(F.col("x"), F.col("m"), F.lit(2.0), 1.5)).first()
    assert one.log_likelihood == pytest.approx(statistics.NormalDist(-2, 3).pdf(-1) and math.log(statistics.NormalDist(-2, 3).pdf(-1)))


def test_latin_hypercube(spark):
    n = 500
    u = d.latin_hypercube(spark.range(n).withColumnRenamed("id", "sample"), ["a", "b"], 3).toPandas()
    for _, g in u.groupby("name"):
        assert sorted(np.ceil(g.u * n).astype(int)) == list(range(1, n + 1))
    wide = d.sample_design(spark, "lhs", ["law"], 10, seed=1)
    picks = wide.select(dist.quantile(F.col("law"), {"distribution": "choices", "choices": ["meansquare", "huber"]}).alias("x")).groupBy("x").count()
    assert {r.x: r["count"] for r in picks.collect()} == {"meansquare": 5, "huber": 5}
    with pytest.raises(ValueError):
        d.sample_design(spark, "sobol", ["a"], 3)


def test_factorial(spark):
    got = [(r.a, r.b) for r in d.full_factorial(spark, ["a", "b"], 3, "endpoint").orderBy("sample").collect()]
    assert got == [(x, y) for x in (0.0, 0.5, 1.0) for y in (0.0, 0.5, 1.0)]
    for bad in ((0, "edge"), (2, "middle")):
        with pytest.raises(ValueError):
            d.levels(*bad)


def test_distributions(spark):
    us = [1e-12, 1e-4, 0.07, 0.5, 0.93, 1 - 1e-9]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    for u, z in df.select("u", dist.inverse_normal(F.col("u"))).collect():
        assert z == pytest.approx(statistics.NormalDist().inv_cdf(u), abs=1e-12)
    ints = df.select(dist.quantile(F.col("u"), {"distribution": "randint", "low": 0, "high": 4})).collect()
    assert [r[0] for r in ints] == [0, 0, 0, 1, 3, 3]
    for bad in ({"distribution": "nope"}, {"distribution": "choices", "choices": []}, {"distribution": "uniform", "loc": 0},
                {"distribution": "truncnorm", "scale": 1, "lower": 2, "upper": 1}, {"distribution": "loggamma", "loc": 0, "scale": 1},
                {"distribution": "choices", "choices": [1, 2], "weights": [0, 0]}):
        with pytest.raises(ValueError):
            dist.check_spec(bad)


def test_derived(spark):
    spec = {"z_max": {"derived_from": "z_min", "offset": 1050}, "z_ela": {"derived_from": "z_max", "offset": 842}}
    got = d.apply_derived(spark.createDataFrame([(0, 700), (1, 400)], "sample int, z_min int"), spec)
    assert dict(got.dtypes)["z_max"] == "bigint" and [(r.z_max, r.z_ela) for r in got.orderBy("sample").collect()] == [(1750, 2592), (1450, 2292)]
    with pytest.raises(KeyError):
        d.derived_order({"a": {"derived_from": "x"}}, ["b"])
    with pytest.raises(ValueError):
        d.derived_order({"a": {"derived_from": "b"}, "b": {"derived_from": "a"}}, [])


def test_lookup_errors(spark):
    codes = spark.createDataFrame([("C009",)], "code string")
    with pytest.raises(PySparkException, match="unknown experiment"):
        d.resolve_experiments(codes, "code", spark).collect()
    with pytest.raises(PySparkException, match="end date"):
        d.resolve_experiments(codes.withColumn("code", F.lit(None).cast("string")), "code", spark).collect()
    design = spark.createDataFrame([(0, 7)], "sample int, flag int")
    with pytest.raises(PySparkException, match="out of range"):
        d.choice_lookup(design, spark.createDataFrame([(0, "x")], "row int, v string"), {"flag": "v"}, "row").collect()
    with pytest.raises(KeyError):
        forcing.build("unknown")
    with pytest.raises(PySparkException, match="experiment id"):
        codes.select(*fx.member_ids_from_name(F.col("code"))).collect()
    with pytest.raises(ValueError):
        units.factor("kg", "yr")
    assert units.factor("kg/s", "Gt/yr") == pytest.approx(31557600e-12)
    with pytest.raises(ValueError):
        d.select_names(["x"], ["a", "b"])
    assert d.select_names(["b", "a"], ["a", "b", "c"]) == ["a", "b"]


@pytest.mark.parametrize("name", ["EPSG:3413", "EPSG:3338", "EPSG:5936", "EPSG:32606", "polar-sphere-30", "rotated-160-18"])
def test_projection_round_trip(spark, name):
    p = spark.createDataFrame([(-150.0, 62.0), (-146.3, 58.1), (-147.0, 70.4)], "lon double, lat double")
    x, y = pj.transform("EPSG:4326", name, F.col("lon"), F.col("lat"))
    q = p.withColumns({"x": x, "y": y})
    lon, lat = pj.transform(name, "EPSG:4326", F.col("x"), F.col("y"))
    for r in q.withColumns({"lo": lon, "la": lat}).collect():
        assert abs(r.lo - r.lon) < 1e-11 and abs(r.la - r.lat) < 1e-11


def test_projection_constants(spark):
    at = lambda n, lon, lat: spark.range(1).select(*[x.alias(k) for k, x in zip("xy", pj.transform("EPSG:4326", n, F.lit(lon), F.lit(lat)))]).first()
    assert tuple(at("EPSG:3338", -154.0, 50.0)) == pytest.approx((0, 0), abs=1e-6)
    assert at("EPSG:32606", -147.0, 0.0).x == pytest.approx(500000)
    k = spark.range(1).select(pj.local_scale_factor("EPSG:3413", F.lit(0.0), F.lit(float(at("EPSG:3413", -45.0, 70.0).y)))).first()[0]
    assert k == pytest.approx(1.0, abs=1e-6)


def test_health_checks(spark):
    pdf = pd.DataFrame([(n, t, y, x, float(x), float(-y if n == "good" else y % 3), 1.0) for n in ("good", "bad") for t in range(2) for y in range(5) for x in range(4)],
                       columns=["n", "t", "iy", "ix", "x", "y", "v"])
    rep = quality.check_cubes(spark.createDataFrame(pdf), "n", ["v"], ["v"], window=2)
    assert {r.n: list(r.errors) for r in rep.collect()} == {"good": [], "bad": ["ValueError: y is not strictly monotonic"]}
    assert quality.exit_code(rep) == 1 and quality.exit_code(rep.where("n = 'good'")) == 0
