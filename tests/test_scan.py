"""Block-wise scans equal plain per-key computation, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import align, design, scan
from fieldspark.operators import series as s


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    key = np.where(rng.random(3000) < 0.6, 0, rng.integers(1, 40, 3000))
    t = rng.permutation(100_000)[:3000]
    v = np.round(rng.normal(size=3000), 1)  # many ties
    v[rng.random(3000) < 0.05] = np.nan
    return pd.DataFrame({"k": key, "t": t, "v": v}).sort_values(["k", "t"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def frame(spark, skewed):
    return spark.createDataFrame(skewed).withColumn("v", F.nanvl("v", F.lit(None))).repartition(7)


@pytest.mark.parametrize("width", [1, 500, 10**9, None])
def test_neighbours_and_running(frame, skewed, width):
    block = scan.number_block("t", width) if width else None
    d = scan.neighbours(frame, ["k"], ["t"], block, prev={"p": "v"}, nxt={"n": "v"})
    d = scan.running(d, ["k"], ["t"], block, {"c": "v"}, inclusive=False)
    got = d.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    g = skewed.groupby("k").v
    pd.testing.assert_series_equal(got.p, g.shift(1), check_names=False)
    pd.testing.assert_series_equal(got.n, g.shift(-1), check_names=False)
    want = skewed.assign(z=skewed.v.fillna(0)).groupby("k").z.cumsum() - skewed.v.fillna(0)
    np.testing.assert_allclose(got.c, want, atol=1e-9)


@pytest.mark.parametrize("width", [700, None])
def test_fill_both_and_index(frame, skewed, width):
    block = scan.number_block("t", width) if width else None
    d = scan.fill_both(frame, ["k"], ["t"], block, {"a": F.col("v")}, {"b": F.col("v")})
    got = scan.dense_index(d, ["k"], ["t"], block, "i").toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    g = skewed.groupby("k").v
    pd.testing.assert_series_equal(got.a, g.ffill(), check_names=False)
    pd.testing.assert_series_equal(got.b, g.bfill(), check_names=False)
    assert (got.i == skewed.groupby("k").cumcount()).all()


def test_exact_quantiles(frame, skewed):
    probs = [0.0, 0.05, 0.5, 0.841, 1.0]
    got = scan.exact_quantiles(frame, ["k"], "v", probs).toPandas().set_index("k").sort_index()
    want = skewed.groupby("k").v.quantile(probs).unstack().sort_index()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-12)
    one = scan.exact_quantiles(frame, [], "v", probs).first()
    np.testing.assert_allclose(list(one), skewed.v.quantile(probs), atol=1e-12)


def test_top_per_key(frame, skewed):
    got = design.top_per_key(frame.where("v is not null"), ["k"], [("v", False), ("t", True)], 3).toPandas()
    want = skewed.dropna().sort_values(["v", "t"], ascending=[False, True]).groupby("k").head(3)
    assert set(zip(got.k, got.t)) == set(zip(want.k, want.t))


@pytest.mark.parametrize("block", [scan, None])
def test_interpolation(spark, block):
    sim = pd.DataFrame({"k": [0] * 4 + [1] * 3, "t": [0.0, 10, 20, 40, 5, 15, 25], "v": [0.0, 1, 4, 2, 7, 7, 9]})
    obs = pd.DataFrame({"k": [0] * 6 + [1] * 3, "t": [-1.0, 0, 5, 10, 39, 41, 5, 20, 30], "id": range(9)})
    b = scan.number_block("t", 8) if block else None
    got = align.interpolate_onto(spark.createDataFrame(sim), spark.createDataFrame(obs), ["k"], "t", ["v"], b).toPandas().sort_values("id")
    want = [np.nan, 0, 0.5, 1, 2.1, np.nan, 7, 8, np.nan]
    np.testing.assert_allclose(got.v, want, atol=1e-12)


def test_integral_closed_forms(spark):
    d = spark.createDataFrame([("a", d, 1.0) for d in ("2020-01-01", "2020-01-02", "2020-03-15", "2020-03-16")], "m string, t string, r double").withColumn("t", F.to_date("t"))
    args = (d, "r", ["m"], ["t"], scan.time_block("t", 10))
    left = [x.cumulative_r for x in s.integrate_rate(*args).orderBy("t").collect()]
    trap = [x.cumulative_r for x in s.integrate_rate(*args, method="trapezoid").orderBy("t").collect()]
    assert left == trap == [0.0, 1.0, 74.0, 75.0]
    month = [x.cumulative_r for x in s.integrate_rate(*args, width=s.month_days(F.col("t"))).orderBy("t").collect()]
    assert month == [31.0, 62.0, 93.0, 124.0]
    per_second = s.integrate_rate(*args, per_days=1 / 86400).orderBy("t").collect()[1]
    assert per_second.cumulative_r == pytest.approx(86400)
    with pytest.raises(ValueError):
        s.integrate_rate(*args, method="simpson")
    with pytest.raises(KeyError):
        s.integrate_rate(d, "nope", ["m"], ["t"], None)


def test_month_axis_needs_twelve(spark):
    with pytest.raises(ValueError):
        s.periodic_month_axis(spark.range(1, 12).withColumnRenamed("id", "month"))
    axis = s.periodic_month_axis(spark.range(1, 13).withColumnRenamed("id", "month")).orderBy("month").collect()
    assert (axis[1].start_day, axis[1].end_day, axis[1].mid_day, axis[11].end_day) == (31.0, 59.0, 45.0, 365.0)


def test_nearest_year(spark):
    y = spark.createDataFrame([(1990,), (1994,), (2001,)], "year int")
    got = {r.target_year: r.source_year for r in align.nearest_year_owner(y, "year", 1985, 2005).collect()}
    assert got == {t: min((1990, 1994, 2001), key=lambda k: (abs(k - t), k)) for t in range(1985, 2006)}
